"""Queries that route quoting blocks to their targets, align them and sum up the run, with equivalent SQL.

Conversations stand for topics and definitions; a turn is a block, linked to a node whose label follows from its number, and the
texts it quotes are those of benchmark items, under keys with padded numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import blocks as B
from textloom.operators import alignment, routing
from textloom.plans.base import query, table
from textloom.plans.retrieval import blocks_of

LABELS = ["Gatha", "GathaTeeka", "GathaTeekaBhaavarth", "Kalash", "KalashBhaavarth", "Page"]
BLOCK_KINDS = ["sanskrit_text", "sanskrit_text", "hindi_text", "hindi_text", "hindi_text", "hindi_text"]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose kind follows from their place; they quote a benchmark item in full, and every second one has a translation."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("quoted"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumn("item_id", (F.col("conv_id") + F.col("turn")) % 40)
    kind = F.element_at(F.array(*[F.lit(k) for k in BLOCK_KINDS]), (F.col("turn") % 6 + 1).cast("int"))
    none = F.lit(None).cast("int")
    return rows.join(F.broadcast(items), "item_id", "left").select(F.lit("topic_extract").alias("kind"), F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("parent"), none.alias("section_index"), none.alias("definition_index"), F.col("turn").cast("int").alias("block_index"), kind.alias("block_kind"), F.col("quoted").alias("text"), F.when(F.col("turn") % 2 == 0, F.col("quoted")).alias("translation"), F.lit("r").alias("reference"), "item_id")


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """edges, stubs, works and texts; works w0 and w1 number by chapter and verse, and texts pad their numbers."""
    rows = _sources(spark, sf_dir)
    label = F.element_at(F.array(*[F.lit(v) for v in LABELS]), (F.col("block_index") % 6 + 1).cast("int"))
    work = F.concat(F.lit("w"), (F.col("item_id") % 4).cast("string"))
    number = F.col("item_id").cast("string")
    verse = F.when(F.col("item_id") % 4 < 2, F.concat(work, F.lit(":अध्याय:1:गाथा:"), number)).otherwise(F.concat(work, F.lit(":गाथा:"), number))
    stub = F.when(label == "Gatha", verse).when(label == "Kalash", F.concat(work, F.lit(":k:कलश:"), number)).otherwise(F.concat(work, F.lit(":"), label, F.lit(":"), number))
    linked = rows.withColumn("stub", stub).withColumn("label", label)
    stubs = linked.select("stub", "label", F.concat(work, F.lit(":tika")).alias("commentary"), F.concat(work, F.lit(":tika:0")).alias("publication"), verse.alias("verse"), number.alias("interlude"), work.alias("work")).distinct()
    works = spark.createDataFrame([(f"w{k}", ["अध्याय", f"w{k}गाथा"] if k < 2 else None) for k in range(4)], "work string, fields array<string>")
    item = table(spark, sf_dir, "benchmark").select("item_id", "text").withColumn("work", F.concat(F.lit("w"), (F.col("item_id") % 4).cast("string"))).withColumn("padded", F.lpad(F.col("item_id").cast("string"), 4, "0"))
    named = F.when(F.col("item_id") % 4 < 2, F.concat(F.lit("अध्याय:1:गाथा:"), "padded")).otherwise(F.col("padded"))
    whole = F.when(F.col("item_id") % 4 < 2, F.concat_ws(":", "work", named)).otherwise(F.concat(F.col("work"), F.lit(":गाथा:"), "padded"))
    texts = None
    for collection, key, keep in (("gatha_sanskrit", F.concat(whole, F.lit(":sanskrit")), "item_id % 5 <> 0"), ("gatha_teeka_sanskrit", F.concat(F.col("work"), F.lit(":tika:"), named, F.lit(":टीका:san")), "true"), ("gatha_teeka_bhaavarth_hindi", F.concat(F.col("work"), F.lit(":tika:0:"), named, F.lit(":भावार्थ:hi")), "item_id % 3 <> 0"), ("kalash_hindi", F.concat(F.col("work"), F.lit(":k:कलश:"), "padded", F.lit(":hi")), "true")):
        one = item.filter(keep).select(F.lit(collection).alias("collection"), key.alias("key"), "text")
        texts = one if texts is None else texts.unionByName(one)
    return linked.select("stub", *routing.PLACE), stubs, works, texts


_SQL = """s AS (SELECT DISTINCT conv_id, turn, (conv_id + turn) % 40 AS item, turn % 6 AS l, 'w' || ((conv_id + turn) % 40 % 4) AS work, (conv_id + turn) % 40 % 4 < 2 AS compound, lpad(CAST((conv_id + turn) % 40 AS VARCHAR), 4, '0') AS padded FROM conversations),
n AS (SELECT *, CASE WHEN compound THEN 'अध्याय:1:गाथा:' || padded ELSE padded END AS named, CASE WHEN compound THEN 'अध्याय:1:गाथा:' || item ELSE CAST(item AS VARCHAR) END AS plain, CASE WHEN compound THEN work || ':अध्याय:1:गाथा:' ELSE work || ':गाथा:' END AS head FROM s),
p AS (SELECT *, CASE l WHEN 0 THEN item % 5 = 0 WHEN 2 THEN item % 3 = 0 WHEN 4 THEN true ELSE false END AS missing FROM n WHERE l <> 5),
t AS (SELECT conv_id, turn, missing, CASE l WHEN 0 THEN 'gatha_sanskrit' WHEN 1 THEN 'gatha_teeka_sanskrit' WHEN 2 THEN 'gatha_teeka_bhaavarth_hindi' WHEN 3 THEN 'kalash_hindi' ELSE 'kalash_bhaavarth_hindi' END AS collection,
 CASE l WHEN 0 THEN CASE WHEN missing THEN head || item ELSE head || padded END || ':sanskrit' WHEN 1 THEN work || ':tika:' || named || ':टीका:san' WHEN 2 THEN work || ':tika:0:' || CASE WHEN missing THEN plain ELSE named END || ':भावार्थ:hi' WHEN 3 THEN work || ':k:कलश:' || padded || ':hi' ELSE work || ':tika:0:कलश:भावार्थ:' || item END AS key FROM p)"""


@query(f"""WITH {_SQL} SELECT 't' || conv_id AS parent, CAST(turn AS INTEGER) AS block_index, collection, key, missing FROM t""")
def match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that every linked block quotes: by its route, and by its key whatever the padding of the number."""
    edges, stubs, works, texts = _links(spark, sf_dir)
    found = routing.primary_targets(_sources(spark, sf_dir).drop("item_id"), edges, stubs, works, texts)
    return found.select("parent", "block_index", "collection", "key", "missing")


def _with_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, stubs, works, texts = _links(spark, sf_dir)
    found = routing.primary_targets(_sources(spark, sf_dir).drop("item_id"), edges, stubs, works, texts)
    item = table(spark, sf_dir, "benchmark").withColumn("work", F.concat(F.lit("w"), (F.col("item_id") % 4).cast("string")))
    padded = F.lpad(F.col("item_id").cast("string"), 4, "0")
    head = F.when(F.col("item_id") % 4 < 2, F.lit(":अध्याय:1:गाथा:")).otherwise(F.lit(":गाथा:"))
    glosses = item.select(F.concat(F.col("work"), head, padded).alias("verse"), F.explode(F.array(*[F.struct(F.concat(F.lit(k), F.col("item_id").cast("string")).alias("key"), (F.col("text") if k == "g1:" else F.lit("")).alias("text")) for k in ("g2:", "g1:")])).alias("x")).select("verse", "x.*")
    named = F.when(F.col("item_id") % 4 < 2, F.concat(F.lit("अध्याय:1:गाथा:"), padded)).otherwise(padded)
    paraphrases = item.select(F.explode(F.array(*[F.struct(F.concat(F.col("work"), F.lit(f":{pub}:"), named).alias("owner"), F.concat(F.lit(f"{pub}/"), F.col("item_id").cast("string")).alias("key"), (F.col("text") if pub != "empty" else F.lit("")).alias("text")) for pub in ("tika", "vritti", "empty")])).alias("x")).select("x.*")
    return found.unionByName(routing.secondary_targets(found, glosses, paraphrases))


@query(f"""WITH {_SQL}, told AS (SELECT n.conv_id, n.turn, n.item, n.l, t.missing FROM n JOIN t ON t.conv_id = n.conv_id AND t.turn = n.turn WHERE n.turn % 2 = 0 AND n.item IN (SELECT item_id FROM benchmark))
SELECT 't' || conv_id AS parent, CAST(turn AS INTEGER) AS block_index, 'teeka_gatha_mapping' AS collection, 'g1:' || item AS key FROM told WHERE l = 0 AND NOT missing UNION ALL
SELECT 't' || conv_id, CAST(turn AS INTEGER), 'gatha_teeka_bhaavarth_hindi', pub || '/' || item FROM told CROSS JOIN (VALUES ('tika'), ('vritti')) x(pub) WHERE l = 0""")
def secondary_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gloss and the paraphrases that a block's translation is sought in, beside the verse that it quotes."""
    return _with_secondary(spark, sf_dir).filter("of = 'translation'").select("parent", "block_index", "collection", "key")


@query(f"""WITH {_SQL}, u AS (SELECT t.*, b.item_id IS NOT NULL AS has FROM t LEFT JOIN benchmark b ON b.item_id = (t.conv_id + t.turn) % 40)
SELECT 'match:topic_extract:t' || conv_id || ':b' || turn || ':target:' || key AS natural_key, CASE WHEN missing THEN 'target_missing' WHEN has THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN missing OR NOT has THEN 'none' ELSE 'exact_normalized' END AS method, CASE WHEN missing OR NOT has THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM u""")
def match_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of all targets: key, status, method and score."""
    edges, stubs, works, texts = _links(spark, sf_dir)
    found = routing.primary_targets(_sources(spark, sf_dir).drop("item_id"), edges, stubs, works, texts)
    aligned = alignment.align(found.withColumn("sought", F.col("text")), "sought", "target_text", "match_kind")
    return routing.match_rows(aligned, "run").select("natural_key", "match.status", "match.method", "match.score")


@query(f"""WITH {_SQL}, u AS (SELECT t.*, b.item_id IS NOT NULL AS has FROM t LEFT JOIN benchmark b ON b.item_id = (t.conv_id + t.turn) % 40), c AS (SELECT count(*) AS attempted, count(*) FILTER (WHERE NOT missing AND has) AS matched, count(*) FILTER (WHERE NOT missing AND NOT has) AS unmatched, count(*) FILTER (WHERE missing) AS missing FROM u)
SELECT *, (SELECT count(*) FROM s) AS processed, missing > 0 OR unmatched >= 0.5 * attempted AS failed FROM c""")
def match_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a run over all blocks, and whether it failed."""
    edges, stubs, works, texts = _links(spark, sf_dir)
    sources = _sources(spark, sf_dir).drop("item_id")
    found = routing.primary_targets(sources, edges, stubs, works, texts)
    aligned = alignment.align(found.withColumn("sought", F.col("text")), "sought", "target_text", "match_kind")
    return routing.run_statistics(routing.match_rows(aligned, "run"), sources)


@query(f"""WITH {_SQL} SELECT DISTINCT 't' || conv_id AS parent, CAST(turn AS INTEGER) AS block_index FROM s WHERE work = 'w2'""")
def blocks_of_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are linked to anything of one work."""
    edges, stubs, _, _ = _links(spark, sf_dir)
    return routing.affected_blocks(edges, stubs, "w2").select("parent", "block_index")


@query("""WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE WHEN turn % 5 = 4 THEN 'see_also' WHEN role = 'system' THEN 'table' ELSE 'hindi_text' END AS kind FROM conversations)
SELECT 'topic_extract' AS kind, conv_id AS parent, -1 AS definition_index, CAST(i AS INTEGER) AS block_index, CASE turn % 4 WHEN 3 THEN 'a' ELSE 'w' || (conv_id % 7) END AS reference FROM b WHERE kind = 'hindi_text' AND turn % 4 IN (1, 3) UNION ALL
SELECT 'keyword_definition', conv_id, CASE WHEN i < 2 THEN 0 ELSE 1 END, CAST(CASE WHEN i < 2 THEN i ELSE i - 2 END AS INTEGER), CASE turn % 4 WHEN 3 THEN 'a' ELSE 'w' || (conv_id % 7) END FROM b WHERE kind = 'hindi_text' AND turn % 4 IN (1, 3)""")
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of topics and of definitions that have text and show a reference, with their place and that reference."""
    docs = blocks_of(spark, sf_dir)
    two = F.array(F.struct(F.lit(0).alias("definition_index"), F.slice("blocks", 1, 2).alias("blocks")), F.struct(F.lit(1).alias("definition_index"), F.slice("blocks", 3, 1_000_000).alias("blocks")))
    sections = docs.select("nk", F.array(F.struct(F.lit(0).alias("section_index"), two.alias("definitions"))).alias("sections"))
    both = routing.extract_blocks(docs).unionByName(routing.definition_blocks(sections))
    return routing.selected(both).select("kind", "parent", F.coalesce("definition_index", F.lit(-1)).alias("definition_index"), "block_index", "reference")


@query("""SELECT conv_id AS nk, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(CASE WHEN turn % 4 IN (1, 3) THEN 1 ELSE 0 END) AS BIGINT) AS showing FROM conversations GROUP BY 1""")
def blocks_and_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each topic beside the results by their place, how many show a reference among them."""
    rows = blocks_of(spark, sf_dir).select("nk", F.posexplode("blocks").alias("place", "block"))
    shown = rows.select("nk", "place", F.size(B.shown_places(F.col("block.references"))).alias("n")).filter("n > 0")
    return rows.join(shown, ["nk", "place"], "left").groupBy("nk").agg(F.count(F.lit(1)).alias("blocks"), F.count("n").alias("showing"))
