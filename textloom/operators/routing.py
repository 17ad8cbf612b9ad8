"""From blocks that quote to the texts they quote: source blocks, the target of each, and the rows of results.

A source block is a row (kind, parent, section_index, definition_index, block_index, block_kind, text, translation, reference);
a target a row with the block's place, a collection, a key and the text found there, if any. Keys are compared first as they
are, then without the zeros of their last number, so that keys of any padding meet in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import blocks as B
from textloom.functions import keys as K

#: Where the text quoted by a block of a kind is, by the label of the node that the block is linked to.
ROUTES = {
    ("Gatha", "prakrit_gatha"): ("gatha_prakrit", "pra"),
    ("Gatha", "prakrit_text"): ("gatha_prakrit", "pra"),
    ("Gatha", "sanskrit_gatha"): ("gatha_sanskrit", "san"),
    ("Gatha", "sanskrit_text"): ("gatha_sanskrit", "san"),
    ("GathaTeeka", "sanskrit_text"): ("gatha_teeka_sanskrit", "san"),
    ("GathaTeekaBhaavarth", "hindi_text"): ("gatha_teeka_bhaavarth_hindi", "hin"),
    ("Kalash", "sanskrit_gatha"): ("kalash_sanskrit", "san"),
    ("Kalash", "sanskrit_text"): ("kalash_sanskrit", "san"),
    ("Kalash", "hindi_gatha"): ("kalash_hindi", "hin"),
    ("Kalash", "hindi_text"): ("kalash_hindi", "hin"),
    ("KalashBhaavarth", "hindi_text"): ("kalash_bhaavarth_hindi", "hin"),
}
GLOSS, PARAPHRASE = "teeka_gatha_mapping", "gatha_teeka_bhaavarth_hindi"
PLACE = ["kind", "parent", "section_index", "definition_index", "block_index"]
VERSION = "1.0.0"


def _quotes(block: Column) -> Column:
    return ~F.coalesce(block["kind"], F.lit("")).isin(*B.NO_TEXT) & (F.size(B.shown_places(block["references"])) > 0)


def _block_columns() -> list[Column]:
    work = F.get(B.shown_references(F.col("block")["references"]), 0)["work_name"]
    return ["block_index", F.col("block.kind").alias("block_kind"), F.col("block.text").alias("text"), F.col("block.translation").alias("translation"), work.alias("reference")]


def definition_blocks(docs: DataFrame) -> DataFrame:
    """Source blocks of definitions: docs (nk, sections of (section_index, definitions of (definition_index, blocks)))."""
    rows = docs.select(F.lit("keyword_definition").alias("kind"), F.col("nk").alias("parent"), F.explode("sections").alias("s"))
    rows = rows.select("kind", "parent", F.col("s.section_index").alias("section_index"), F.explode("s.definitions").alias("d"))
    rows = rows.select("kind", "parent", "section_index", F.col("d.definition_index").alias("definition_index"), F.posexplode("d.blocks").alias("block_index", "block"))
    return rows.filter(_quotes(F.col("block"))).select(*PLACE[:4], *_block_columns())


def extract_blocks(docs: DataFrame) -> DataFrame:
    """Source blocks of topics: docs (nk, blocks)."""
    none = F.lit(None).cast("int")
    rows = docs.select(F.lit("topic_extract").alias("kind"), F.col("nk").alias("parent"), none.alias("section_index"), none.alias("definition_index"), F.posexplode("blocks").alias("block_index", "block"))
    return rows.filter(_quotes(F.col("block"))).select(*PLACE[:4], *_block_columns())


def selected(blocks: DataFrame, parents: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The source blocks of some parents, or all; the first ``limit``, definitions first."""
    kept = blocks.filter(F.col("parent").isin(*parents)) if parents is not None else blocks
    return kept if limit is None else kept.orderBy(*PLACE).limit(limit)


def routes(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(*k, *v) for k, v in ROUTES.items()], "label string, block_kind string, collection string, lang string"))


def target_key(label: Column, block_kind: Column, stub: Column, commentary: Column, publication: Column, verse: Column, interlude: Column, work: Column, fields: Column) -> Column:
    """The key of the text that a node stands for; null if it lacks what the key is made of."""
    named = K.key_segment(work, fields, verse)
    some = lambda *needs: [n.isNotNull() & (n != "") for n in needs]
    both = lambda key, *needs: F.when(F.reduce(F.array(*some(*needs)), F.lit(True), lambda a, b: a & b), key)
    return (
        F.when((label == "Gatha") & block_kind.startswith("prakrit"), F.concat(stub, F.lit(":prakrit")))
        .when((label == "Gatha") & block_kind.startswith("sanskrit"), F.concat(stub, F.lit(":sanskrit")))
        .when(label == "GathaTeeka", both(F.concat_ws(":", commentary, named, F.lit("टीका:san")), commentary, named))
        .when(label == "GathaTeekaBhaavarth", both(F.concat_ws(":", publication, named, F.lit("भावार्थ:hi")), publication, named))
        .when((label == "Kalash") & block_kind.startswith("sanskrit"), F.concat(stub, F.lit(":san")))
        .when((label == "Kalash") & block_kind.startswith("hindi"), F.concat(stub, F.lit(":hi")))
        .when(label == "KalashBhaavarth", both(F.concat_ws(":", publication, F.lit("कलश:भावार्थ"), interlude), publication, interlude))
    )


def primary_targets(blocks: DataFrame, edges: DataFrame, stubs: DataFrame, works: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each edge of a source block that has a route: the target's key and text, null where it is missing.

    edges (stub, kind, parent, section_index, definition_index, block_index), stubs (stub, label, commentary, publication,
    verse, interlude, work), works (work, fields), texts (collection, key, text). Of several texts whose keys are equal but
    for zeros the one written alike is taken, else the least.
    """
    spark = blocks.sparkSession
    b, e = blocks.alias("b"), edges.alias("e")
    on = [F.col(f"b.{c}").eqNullSafe(F.col(f"e.{c}")) for c in PLACE]
    linked = b.join(e, on).select("b.*", "e.stub").join(stubs, "stub").join(routes(spark), ["label", "block_kind"])
    linked = linked.withColumn("work", F.coalesce("work", F.get(F.split("stub", ":"), 0))).join(works, "work", "left")
    linked = linked.withColumn("verse", F.when(F.col("label") == "Gatha", F.col("stub")).otherwise(F.col("verse")))
    key = target_key(*[F.col(c) for c in ("label", "block_kind", "stub", "commentary", "publication", "verse", "interlude", "work", "fields")])
    wanted = linked.withColumn("wanted", key).filter("wanted IS NOT NULL").withColumn("plain", K.any_width(F.col("wanted")))
    known = texts.select("collection", K.any_width(F.col("key")).alias("plain"), "key", F.col("text").alias("target_text"))
    found = wanted.join(known, ["collection", "plain"], "left")
    best = Window.partitionBy(*PLACE, "stub", "collection", "wanted").orderBy((F.col("key") != F.col("wanted")).asc_nulls_last(), "key")
    one = found.withColumn("n", F.row_number().over(best)).filter("n = 1")
    own = F.when((F.col("label") == "Gatha") & F.col("key").isNotNull(), F.regexp_replace("key", ":[^:]*$", "")).otherwise(F.col("verse"))
    return one.select(*PLACE, "block_kind", "text", "translation", "reference", "stub", "label", "work", "fields", own.alias("verse"), "commentary", "collection", "lang", F.coalesce("key", "wanted").alias("key"), F.col("key").isNull().alias("missing"), "target_text", F.lit("text").alias("of"), F.col("block_kind").alias("match_kind"))


def secondary_targets(primary: DataFrame, glosses: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """Targets of a block's translation: a verse's first gloss, and the paraphrases of the verse or commentary.

    glosses (verse, key, text), paraphrases (owner, key, text), owner being commentary:verse; those without a text give no row.
    """
    told = primary.filter(F.coalesce("translation", F.lit("")) != "")
    verse = told.filter(F.col("collection").isin("gatha_prakrit", "gatha_sanskrit") & F.col("verse").isNotNull())
    first = glosses.groupBy("verse").agg(F.min(F.struct("key", "text")).alias("g")).select("verse", F.col("g.key").alias("gloss_key"), F.col("g.text").alias("gloss_text")).filter("gloss_text <> ''")
    asked = lambda rows, collection, label, key, text: rows.select(*[c for c in primary.columns if c not in {"label", "collection", "lang", "key", "missing", "target_text", "of", "match_kind"}], F.lit(label).alias("label"), F.lit(collection).alias("collection"), F.lit("hin").alias("lang"), F.col(key).alias("key"), F.lit(False).alias("missing"), F.col(text).alias("target_text"), F.lit("translation").alias("of"), F.lit("hindi_text").alias("match_kind"))
    gloss = asked(verse.join(first, "verse"), GLOSS, "Gatha", "gloss_key", "gloss_text")
    owned = paraphrases.filter("text <> ''").select(K.any_width(F.col("owner")).alias("plain"), F.col("key").alias("para_key"), F.col("text").alias("para_text"))
    # The owner's middle part names the publication: without it, the work and the verse are left.
    by_verse = owned.withColumn("plain", F.regexp_replace("plain", r"^([^:]*):[^:]*:", "$1:"))
    named = K.any_width(F.concat_ws(":", "work", K.key_segment(F.col("work"), F.col("fields"), F.col("verse"))))
    each = asked(verse.withColumn("plain", named).join(by_verse, "plain"), PARAPHRASE, "GathaTeekaBhaavarth", "para_key", "para_text")
    taught = told.filter("collection = 'gatha_teeka_sanskrit'").withColumn("plain", K.any_width(F.regexp_replace("key", ":टीका:(san|hi)$", "")))
    least = owned.groupBy("plain").agg(F.min(F.struct("para_key", "para_text")).alias("p")).select("plain", "p.*")
    return gloss.unionByName(each).unionByName(asked(taught.join(least, "plain"), PARAPHRASE, "GathaTeekaBhaavarth", "para_key", "para_text"))


def affected_blocks(edges: DataFrame, stubs: DataFrame, work: str) -> DataFrame:
    """The places of the source blocks that are linked to any node of a work, once each."""
    of = stubs.filter(F.col("work") == work).select("stub")
    return edges.join(of, "stub", "left_semi").select(*PLACE).distinct()


def match_key() -> Column:
    """The key of a result: the block's place and the target's key."""
    place = F.when(F.col("kind") == "keyword_definition", F.concat(F.lit(":s"), F.col("section_index").cast("string"), F.lit(":d"), F.col("definition_index").cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("match:"), "kind", F.lit(":"), "parent", place, F.lit(":b"), F.col("block_index").cast("string"), F.lit(":target:"), "key")


def match_rows(aligned: DataFrame, run_id: str) -> DataFrame:
    """Result rows (key, source, target, match, matcher_version, run_id) of aligned targets, one for each key.

    A target that is missing is not aligned; one without a text, or a block without one, is unmatched.
    """
    status = F.when(F.col("missing"), "target_missing").when(F.col("status") == "matched", "matched").otherwise("unmatched")
    hit = status == "matched"
    source = F.struct("kind", "parent", "section_index", "definition_index", "block_index", "block_kind", "reference", F.col("of").alias("text_of"))
    target = F.struct("collection", F.col("key").alias("natural_key"), "label", "work", "verse", "lang")
    match = F.struct(status.alias("status"), F.when(F.col("missing"), "none").otherwise(F.coalesce("method", F.lit("none"))).alias("method"), F.when(F.col("missing"), 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), F.when(hit, F.col("char_start")).alias("char_start"), F.when(hit, F.col("char_end")).alias("char_end"), "threshold")
    rows = aligned.select(match_key().alias("natural_key"), source.alias("source"), target.alias("target"), match.alias("match"), F.lit(VERSION).alias("matcher_version"), F.lit(run_id).alias("run_id"))
    return rows.groupBy("natural_key").agg(F.min(F.struct("source", "target", "match", "matcher_version", "run_id")).alias("x")).select("natural_key", "x.*")


def run_statistics(results: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: blocks processed, targets attempted, matched, unmatched, missing, and whether the run failed.

    A run fails if a target is missing, or if half of the targets or more are unmatched.
    """
    is_ = lambda s: F.count_if(F.col("match.status") == s)
    sums = results.agg(F.count(F.lit(1)).alias("attempted"), is_("matched").alias("matched"), is_("unmatched").alias("unmatched"), is_("target_missing").alias("missing"))
    failed = (F.col("missing") > 0) | ((F.col("attempted") > 0) & (F.col("unmatched") >= 0.5 * F.col("attempted")))
    return sums.crossJoin(F.broadcast(blocks.agg(F.count(F.lit(1)).alias("processed")))).withColumn("failed", failed)
