"""Queries of token resolution, topic matching, graph retrieval and hydration, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import blocks as B
from textloom.functions import text as T
from textloom.operators import graph, resolve
from textloom.plans.base import keyed, query, sql_similarity, table

STEM = "घर"
#: Inflected stems, aliases, joiners, a repeated token, and words that only resemble a term.
TOKENS = ["red bolt", f"{STEM}3ोंमें", f"{STEM}7ियाँ", f"{STEM}9के", f" {STEM}‍4 ", "ECONOMY", "asia", "asiaको", "red bolts", "blue gearing", "red bolt", "zzz", "bolt red", f"{STEM}31", f"{STEM}2ं"]


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    terms = part.select(F.col("p_name").alias("term")).distinct().unionByName(nation.select(keyed(STEM, "n_nationkey").alias("term")))
    aliases = part.groupBy(F.col("p_type").alias("alias")).agg(F.min("p_name").alias("term")).unionByName(region.select(F.lower("r_name").alias("alias"), keyed(STEM, "r_regionkey").alias("term")))
    return terms, aliases


_VALUES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(dict.fromkeys(TOKENS)))
_TERMS_SQL = f"""tokens AS (SELECT pos, token, trim(replace(replace(nfc_normalize(token), '‍', ''), '‌', '')) AS norm FROM (VALUES {_VALUES}) v(pos, token)),
terms AS (SELECT DISTINCT p_name AS term FROM part UNION ALL SELECT '{STEM}' || n_nationkey FROM nation),
aliases AS (SELECT p_type AS alias, min(p_name) AS term FROM part GROUP BY 1 UNION ALL SELECT lower(r_name), '{STEM}' || r_regionkey FROM region)"""
_STRIP = "CASE " + " ".join(f"WHEN ends_with(norm, '{s}') AND length(norm) > {len(s) + 1} THEN substr(norm, 1, length(norm) - {len(s)})" for s in T.SUFFIXES) + " END"
_END = f"CASE WHEN length(norm) > 1 AND contains('{T.END_MARKS}', substr(norm, length(norm), 1)) THEN substr(norm, 1, length(norm) - 1) END"
_HITS = """forms AS (SELECT pos, 0 AS step, norm AS form FROM tokens UNION ALL SELECT pos, 1, {strip} FROM tokens),
hits AS (SELECT pos, 2 * step AS prio, term FROM forms JOIN terms ON term = form UNION ALL SELECT pos, 2 * step + 1, min(term) FROM forms JOIN aliases ON alias = form GROUP BY 1, 2),
best AS (SELECT pos, min(prio) AS prio, arg_min(term, prio) AS term FROM hits GROUP BY 1)"""
_KIND = "CASE prio WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' ELSE CASE WHEN prio IS NULL THEN 'none' ELSE 'suffix_strip' END END"
_NEAR = f"""names AS (SELECT term, term AS name FROM terms UNION ALL SELECT term, alias FROM aliases),
near AS (SELECT t.pos, n.term, n.name, {sql_similarity('t.norm', 'n.name')} AS sim FROM tokens t CROSS JOIN names n WHERE t.pos NOT IN (SELECT pos FROM best)),
top AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY sim DESC, term, name) AS place FROM near WHERE sim >= 0.35 QUALIFY place <= 5)"""


@query(f"""WITH {_TERMS_SQL}, {_HITS.format(strip=_STRIP)}, {_NEAR}
SELECT t.pos, token, {_KIND} AS kind, term, coalesce((SELECT string_agg(top.term || '=' || CAST(CAST(round(top.sim * 10000) AS BIGINT) AS VARCHAR), '|' ORDER BY place) FROM top WHERE top.pos = t.pos), '') AS suggestions
FROM tokens t LEFT JOIN best USING (pos)""")
def resolve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to terms in four passes, with suggestions for the rest, in input order."""
    found = resolve.resolve_tokens(resolve.token_rows(spark, TOKENS), *_terms(spark, sf_dir))
    shown = F.transform("suggestions", lambda s: F.concat(s["term"], F.lit("="), F.round(s["similarity"] * 10000).cast("long").cast("string")))
    return found.withColumn("suggestions", F.array_join(shown, "|"))


@query(f"WITH {_TERMS_SQL}, {_HITS.format(strip=_END)} SELECT t.pos, token, {_KIND} AS kind, term FROM tokens t LEFT JOIN best USING (pos)")
def resolve_one_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to terms with one mark at the end stripped."""
    return resolve.resolve_each(resolve.token_rows(spark, TOKENS), *_terms(spark, sf_dir))


@query(f"""WITH {_TERMS_SQL} SELECT DISTINCT pos, token, term FROM tokens JOIN (SELECT term AS form, term FROM terms UNION ALL SELECT alias, term FROM aliases) ON form = norm""")
def resolve_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to term nodes, by their own key or by an alias node's edge."""
    terms, aliases = _terms(spark, sf_dir)
    nodes = terms.select(F.col("term").alias("nk"), F.lit("keyword").alias("label")).unionByName(aliases.select(F.col("alias").alias("nk"), F.lit("alias").alias("label")))
    edges = aliases.select(F.lit("ALIAS_OF").alias("type"), F.col("alias").alias("src"), F.col("term").alias("dst"))
    return resolve.resolve_by_alias_edges(resolve.token_rows(spark, TOKENS), nodes, edges)


@query("""SELECT doc_id, nfc_normalize(replace(replace(text, chr(233), 'e' || chr(769)), chr(232), 'e' || chr(768))) AS text FROM documents""")
def normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose accents were split off, in Unicode's normal form C again."""
    split = F.replace(F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00e8"), F.lit("e\u0300"))
    return resolve.nfc(table(spark, sf_dir, "documents").select("doc_id", split.alias("text")), "text")


MATCHES = {"topic_phrase": ("red bolt", None, False, True, 0.5), "topic_words": ("steel anvil व x", ["steel", "व", "an‍vil", "x"], False, False, 1.0), "topic_leaves": ("ring", None, True, True, 0.3)}


def _topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with virama in some words of their keys; every third one has no content."""
    name = F.replace(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("v"), F.lit("v्"))
    return table(spark, sf_dir, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit(":"), name, F.lit(":"), F.col("p_partkey").cast("string")).alias("nk"), F.to_json(F.struct(F.lit("hi").alias("lang"), F.col("p_name").alias("text"))).alias("display"), (F.col("p_size") % 2 == 0).alias("is_leaf"), (F.col("p_partkey") % 3).alias("content"))


def _match_sql(phrase: str, tokens: list[str] | None, leaf_only: bool, content_only: bool, least: float) -> str:
    kept = [t for t in (tokens or phrase.split()) if t.strip() not in T.STOP_WORDS]
    folded = list(dict.fromkeys(f for t in kept if len(f := t.lower().replace("‍", "").replace("्", "")) >= 2))
    cover = " + ".join(f"CASE WHEN len(list_filter(segs, lambda s: starts_with(s, '{t}'))) > 0 THEN 1 ELSE 0 END" for t in folded)
    return f"""SELECT '{phrase}' AS phrase, nk, round(raw * coverage, 6) AS similarity, round(raw * coverage * CASE WHEN is_leaf THEN 1.0 ELSE 0.6 END, 6) AS score FROM (
 SELECT *, ({cover}) / {float(len(folded))} AS coverage FROM (SELECT *, greatest({sql_similarity("replace(nk, '/', ' ')", f"'{phrase}'")}, CASE WHEN contains(lower(name), '{phrase}') THEN 1.0 ELSE 0.0 END) AS raw,
  list_transform(list_filter(string_split_regex(lower(nk), '[ /:-]+'), lambda s: s <> ''), lambda s: replace(s, chr(2381), '')) AS segs FROM topics) WHERE raw >= 0.3)
 WHERE coverage >= {least}{' AND is_leaf' if leaf_only else ''}{' AND content > 0' if content_only else ''} ORDER BY score DESC, nk LIMIT 20"""


@query("""WITH topics AS (SELECT replace(p_brand, '#', '/') || ':' || replace(replace(p_name, ' ', '-'), 'v', 'v' || chr(2381)) || ':' || p_partkey AS nk, p_name AS name, p_size % 2 = 0 AS is_leaf, p_partkey % 3 AS content FROM part)
""" + " UNION ALL ".join(f"SELECT * FROM ({_match_sql(*m)})" for m in MATCHES.values()))
def topics_match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases to topics: with and without the filters on leaves and content, stop words, joiners and short tokens."""
    out = None
    for phrase, tokens, leaf_only, content_only, least in MATCHES.values():
        one = resolve.topics_match(_topic_rows(spark, sf_dir), phrase, tokens, 20, 0.3, leaf_only, content_only, least).select(F.lit(phrase).alias("phrase"), "nk", "similarity", "score")
        out = one if out is None else out.unionByName(one)
    return out


def knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (nk, label, is_leaf, content, is_stub) and edges of a graph of terms, topics and verses.

    Regions and nations are topics without content, suppliers topics of which every third has none, customers terms, parts
    up to the tenth of each supplier verses; a supplier is a part of its nation, and related to the next supplier.
    """
    region, nation, supplier, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    node = lambda df, p, c, label, leaf, content, stub: df.select(keyed(p, c).alias("nk"), F.lit(label).alias("label"), leaf.alias("is_leaf"), content.alias("content"), stub.alias("is_stub"))
    no, zero = F.lit(False), F.lit(0)
    nodes = node(region, "r", "r_regionkey", "topic", no, zero, no).unionByName(node(nation, "n", "n_nationkey", "topic", no, zero, no))
    nodes = nodes.unionByName(node(supplier, "s", "s_suppkey", "topic", F.col("s_suppkey") % 2 == 0, (F.col("s_suppkey") % 3).cast("int"), F.col("s_suppkey") % 7 == 0))
    nodes = nodes.unionByName(node(customer, "c", "c_custkey", "keyword", no, zero, F.col("c_custkey") % 11 == 0))
    make = lambda df, base, c, kind, src, dst, weight: df.select((F.lit(base) + F.col(c)).cast("long").alias("edge_id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), weight.cast("double").alias("weight"))
    edges = make(nation, 0, "n_nationkey", "PART_OF", keyed("n", "n_nationkey"), keyed("r", "n_regionkey"), F.lit(1.0))
    edges = edges.unionByName(make(supplier, 1_000_000, "s_suppkey", "PART_OF", keyed("s", "s_suppkey"), keyed("n", "s_nationkey"), F.lit(0.5)))
    following = F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string"))
    edges = edges.unionByName(make(supplier.filter("s_suppkey % 4 <> 3"), 2_000_000, "s_suppkey", "RELATED_TO", keyed("s", "s_suppkey"), following, F.lit(None)))
    edges = edges.unionByName(make(customer, 100_000_000, "c_custkey", "HAS_TOPIC", keyed("c", "c_custkey"), keyed("n", "c_nationkey"), F.lit(0.25)))
    edges = edges.unionByName(make(supplier, 3_000_000, "s_suppkey", "IN_SHASTRA", keyed("s", "s_suppkey"), F.lit("r0"), F.lit(1.0)))
    edges = edges.unionByName(make(supplier.filter("s_suppkey % 5 = 0"), 4_000_000, "s_suppkey", "MENTIONS_KEYWORD", keyed("s", "s_suppkey"), keyed("c", "s_suppkey"), F.lit(1.0)))
    return nodes, edges


KNOWLEDGE_SQL = """nodes AS (SELECT 'r' || r_regionkey AS nk, 'topic' AS label, false AS is_leaf, 0 AS content, false AS is_stub FROM region UNION ALL SELECT 'n' || n_nationkey, 'topic', false, 0, false FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'topic', s_suppkey % 2 = 0, s_suppkey % 3, s_suppkey % 7 = 0 FROM supplier UNION ALL SELECT 'c' || c_custkey, 'keyword', false, 0, c_custkey % 11 = 0 FROM customer),
edges AS (SELECT n_nationkey::BIGINT AS id, 'PART_OF' AS type, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 1.0::DOUBLE AS w FROM nation UNION ALL SELECT 1000000 + s_suppkey, 'PART_OF', 's' || s_suppkey, 'n' || s_nationkey, 0.5 FROM supplier
 UNION ALL SELECT 2000000 + s_suppkey, 'RELATED_TO', 's' || s_suppkey, 's' || (s_suppkey + 1), NULL FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT 100000000 + c_custkey, 'HAS_TOPIC', 'c' || c_custkey, 'n' || c_nationkey, 0.25 FROM customer
 UNION ALL SELECT 3000000 + s_suppkey, 'IN_SHASTRA', 's' || s_suppkey, 'r0', 1.0 FROM supplier UNION ALL SELECT 4000000 + s_suppkey, 'MENTIONS_KEYWORD', 's' || s_suppkey, 'c' || s_suppkey, 1.0 FROM supplier WHERE s_suppkey % 5 = 0),
steps AS (SELECT id, type, src AS a, dst AS b, coalesce(w, 1.0) AS w FROM edges WHERE type <> 'IN_SHASTRA' UNION ALL SELECT id, type, dst, src, coalesce(w, 1.0) FROM edges WHERE type <> 'IN_SHASTRA')"""

ASKED = ["c1", "c2", "customer", "c3ों", "c11"]


@query(f"""WITH {KNOWLEDGE_SQL}, seeds(nk) AS (VALUES ('c1'), ('c2'), ('c3'), ('c11')),
h1 AS (SELECT nk AS seed, b AS node, w, id AS i1 FROM seeds JOIN steps ON a = nk), h2 AS (SELECT seed, b AS node, h1.w + s.w AS w, i1, id AS i2 FROM h1 JOIN steps s ON s.a = node AND id <> i1),
h3 AS (SELECT seed, b AS node, h2.w + s.w AS w FROM h2 JOIN steps s ON s.a = node AND id <> i1 AND id <> i2),
hits AS (SELECT seed, node, w FROM h1 UNION ALL SELECT seed, node, w FROM h2 UNION ALL SELECT seed, node, w FROM h3),
sums AS (SELECT node AS topic, is_leaf, count(DISTINCT seed) AS overlap, sum(w) AS weight FROM hits JOIN nodes ON nk = node WHERE label = 'topic' GROUP BY 1, 2)
SELECT topic, overlap, round(weight, 6) AS weight, round((overlap * 10 + least(weight, 5.0)) * CASE WHEN is_leaf THEN 1.0 ELSE 0.5 END, 6) AS score FROM sums ORDER BY score DESC, overlap DESC, weight DESC, topic LIMIT 30""")
def graphrag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to terms, terms over up to three edges to topics, ranked."""
    nodes, edges = knowledge(spark, sf_dir)
    terms = nodes.filter("label = 'keyword'").select(F.col("nk").alias("term"))
    aliases = spark.createDataFrame([], "alias string, term string")
    found = resolve.graphrag(resolve.token_rows(spark, ASKED), terms, aliases, nodes, edges, 3, 30)
    return found.select("topic", "overlap", F.round("weight", 6).alias("weight"), F.round("score", 6).alias("score"))


def _rounds(max_hops: int) -> str:
    """SQL of the rounds of a search in which topics without content are passed for free."""
    out = ["f0 AS (SELECT nk AS anchor, nk AS at, 0 AS depth FROM anchors)", "v0 AS (SELECT nk AS anchor, nk FROM anchors)"]
    for k in range(1, max_hops + 4):
        out.append(f"m{k} AS (SELECT DISTINCT f.anchor, n.nk, n.label, n.content, f.depth FROM f{k - 1} f JOIN near s ON s.a = f.at JOIN nodes n ON n.nk = s.b WHERE f.depth < {max_hops} AND NOT EXISTS (SELECT 1 FROM v{k - 1} v WHERE v.anchor = f.anchor AND v.nk = n.nk))")
        out.append(f"v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT anchor, nk FROM m{k} WHERE label = 'topic')")
        out.append(f"f{k} AS (SELECT anchor, nk AS at, depth + max(CASE WHEN content > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY anchor) AS depth FROM m{k} WHERE label = 'topic')")
    every = " UNION ALL ".join(f"SELECT anchor, label, nk, depth + 1 AS hops FROM m{k} WHERE label = 'keyword' OR content > 0" for k in range(1, max_hops + 4))
    return ", ".join(out) + f", hit AS (SELECT anchor, label, nk, min(hops) AS hops FROM ({every}) GROUP BY 1, 2, 3)"


ANCHORS = ["r0", "r1", "n3", "s5", "s6", "s9"]


@query(f"""WITH {KNOWLEDGE_SQL}, near AS (SELECT DISTINCT a, b FROM steps), anchors(nk) AS (VALUES {', '.join(f"('{a}')" for a in ANCHORS)}), {_rounds(2)}
SELECT anchor, label, nk, CAST(hops AS INTEGER) AS hops, CAST(row_number() OVER (PARTITION BY anchor, label ORDER BY hops, nk) AS INTEGER) AS place FROM hit QUALIFY place <= 25""")
def topic_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with content and terms near several anchors; anchors without content nearby pass through what has none."""
    nodes, edges = knowledge(spark, sf_dir)
    return graph.neighbour_buckets(spark.createDataFrame([(a,) for a in ANCHORS], "nk string"), edges, nodes, 2)


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nk, blocks): conversations as documents; turns are blocks of several kinds, with references by their number."""
    ref = lambda inline, work, commentary, *fields: F.struct(F.lit(inline).alias("inline"), work.alias("work_name"), commentary.alias("commentary_name"), (F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields]) if fields else F.array().cast("array<struct<field:string,value:string>>")).alias("fields"))
    nothing, w = F.lit(None).cast("string"), F.concat(F.lit("w"), (F.col("conv_id") % 7).cast("string"))
    turn = F.col("turn").cast("string")
    refs = F.when(F.col("turn") % 4 == 0, F.array().cast(f"array<{B.REFERENCE}>"))
    refs = refs.when(F.col("turn") % 4 == 1, F.array(ref(True, w, nothing, ("verse", F.lit("9"))), ref(False, w, F.lit(""), ("verse", F.lit("1")), ("verse", turn)), ref(False, w, F.lit("t"), ("page", F.lit("x")))))
    refs = refs.when(F.col("turn") % 4 == 2, F.array(ref(False, w, nothing), ref(True, w, nothing, ("verse_number", turn))))
    refs = refs.otherwise(F.array(ref(True, F.lit("a"), nothing, ("work", w), ("page_number", turn)), ref(True, F.lit("b"), nothing, ("verse", turn))))
    kind = F.when(F.col("turn") % 5 == 4, "see_also").when(F.col("role") == "system", "table").otherwise("hindi_text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("nk"), "turn", F.struct(kind.alias("kind"), F.when(F.col("turn") % 6 != 5, F.col("text")).otherwise(F.lit("  ")).alias("text"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" T:"), F.col("text"))).alias("translation"), refs.alias("references")).cast(B.BLOCK).alias("block"))
    return rows.groupBy("nk").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block")), lambda a, b: (a["turn"] - b["turn"]).cast("int")), lambda x: x["block"]).alias("blocks"))


_BLOCKS_SQL = """b AS (SELECT conv_id AS nk, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, 'w' || (conv_id % 7) AS w,
 CASE WHEN turn % 5 = 4 THEN 'see_also' WHEN role = 'system' THEN 'table' ELSE 'hindi_text' END AS kind, CASE WHEN turn % 6 <> 5 THEN text ELSE '  ' END AS text, CASE WHEN turn % 3 = 0 THEN ' T:' || text END AS translation FROM conversations),
t AS (SELECT *, CASE WHEN kind = 'hindi_text' THEN coalesce(nullif(trim(translation), ''), text) ELSE '' END AS raw FROM b)"""


@query(f"""WITH {_BLOCKS_SQL}
SELECT nk, CAST(i AS INTEGER) AS block_index, CASE WHEN length(raw) > 1500 THEN substr(raw, 1, 1500) || '…' ELSE raw END AS text,
 CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN w || '/9//|' || w || '/' || turn || '//|' || w || '//t/' WHEN 2 THEN w || '///|' || w || '/' || turn || '//' ELSE w || '///' || turn || '|b/' || turn || '//' END AS refs,
 CASE turn % 4 WHEN 1 THEN w WHEN 3 THEN 'a' END AS main_work FROM t WHERE raw <> ''""")
def topic_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with text by their place, the references they give, once each, and the work of the main one."""
    rows = blocks_of(spark, sf_dir).select("nk", F.explode(B.extracts(F.col("blocks"))).alias("x"))
    shown = F.array_join(F.transform("x.references", lambda r: F.concat_ws("/", *[F.coalesce(r[c].cast("string"), F.lit("")) for c in ("work", "verse", "commentary", "page")])), "|")
    return rows.select("nk", "x.block_index", "x.text", shown.alias("refs"), F.col("x.main.work_name").alias("main_work"))


@query(f"""WITH {_BLOCKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY i) - 1 AS n FROM t WHERE kind = 'hindi_text')
SELECT nk, CAST(n AS INTEGER) AS block_index, CAST(length(CASE WHEN length(raw) > 1500 THEN substr(raw, 1, 1500) || '…' ELSE raw END) AS INTEGER) AS n_chars FROM k WHERE raw <> '' AND n < 4""")
def term_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of nested sections by their place among those that can have text, the first four; a blank text counts as one."""
    section = F.array(F.struct(F.array(F.struct(F.slice("blocks", 1, 2).alias("blocks")), F.struct(F.slice("blocks", 3, 100000).alias("blocks"))).alias("definitions")))
    cut = F.filter(B.definitions(section), lambda x: x["block_index"] < 4)
    return blocks_of(spark, sf_dir).select("nk", F.explode(cut).alias("x")).select("nk", "x.block_index", F.length("x.text").alias("n_chars"))


@query(f"""WITH {_BLOCKS_SQL} SELECT nk, count(*) FILTER (WHERE kind = 'hindi_text' AND (trim(text) <> '' OR trim(coalesce(translation, '')) <> '')) AS shown,
 coalesce(string_agg(CASE turn % 4 WHEN 1 THEN '1,2' WHEN 3 THEN '0' ELSE CASE turn % 4 WHEN 0 THEN '-' ELSE '' END END, '|' ORDER BY i), '') AS shown_places,
 coalesce(string_agg(CASE turn % 4 WHEN 1 THEN '1' WHEN 3 THEN '1' WHEN 2 THEN '1' ELSE '0' END, '|' ORDER BY i), '') AS hidden FROM t GROUP BY 1""")
def shown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that show something, places of the references they show, and how many they hide."""
    rows = blocks_of(spark, sf_dir)
    places = F.transform("blocks", lambda b: F.when(F.size(b["references"]) == 0, F.lit("-")).otherwise(F.array_join(F.transform(B.shown_places(b["references"]), lambda i: i.cast("string")), ",")))
    hidden = F.transform("blocks", lambda b: F.size(B.hidden_references(b["references"])).cast("string"))
    return rows.select("nk", B.count_shown(F.col("blocks")).alias("shown"), F.array_join(places, "|").alias("shown_places"), F.array_join(hidden, "|").alias("hidden"))
