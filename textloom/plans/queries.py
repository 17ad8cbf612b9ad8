"""Queries over the test tables, one for each family of operators, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import alignment, graph, merge
from textloom.plans.base import query, sql_similarity, sql_trigrams, sql_word_similarity, table
from textloom.sources import html

_trigrams, _similarity = sql_trigrams, sql_similarity

PHRASE, PHRASE_TOKENS = "red bolts", ["red", "bolt"]


@query(f"""
WITH s AS (SELECT p_partkey, p_name, p_size % 2 = 0 AS is_leaf,
  greatest({_similarity('p_name', f"'{PHRASE}'")}, CASE WHEN contains(lower(p_name), '{PHRASE}') THEN 1.0 ELSE 0.0 END) AS sim,
  (CASE WHEN len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'red'))) > 0 THEN 1 ELSE 0 END
   + CASE WHEN len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'bolt'))) > 0 THEN 1 ELSE 0 END) / 2.0 AS cover FROM part)
SELECT p_partkey, p_name, round(sim, 6) AS similarity, cover AS coverage, round(sim * cover * CASE WHEN is_leaf THEN 1.0 ELSE 0.6 END, 6) AS score
FROM s WHERE sim >= 0.3 AND cover >= 0.5 ORDER BY round(sim * cover * CASE WHEN is_leaf THEN 1.0 ELSE 0.6 END, 6) DESC, p_partkey LIMIT 25""")
def topics_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase to ranked topics: trigram similarity or containment, word coverage, leaf factor."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 2 == 0).alias("is_leaf"))
    names = parts.select("p_name").distinct()
    sim = F.greatest(T.trigram_similarity(F.col("p_name"), F.lit(PHRASE)), F.when(T.literal_like(F.col("p_name"), PHRASE), 1.0).otherwise(0.0))
    names = names.withColumn("sim", sim).withColumn("coverage", T.coverage(T.segments(F.col("p_name")), PHRASE_TOKENS)).filter("sim >= 0.3 AND coverage >= 0.5")
    score = F.round(F.col("sim") * F.col("coverage") * F.when(F.col("is_leaf"), 1.0).otherwise(0.6), 6)
    return parts.join(names, "p_name").select("p_partkey", "p_name", F.round("sim", 6).alias("similarity"), "coverage", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(25)


TOKENS = ["red bolt", "ECONOMY", "red bolts", "blue gearing", "zzz"]
_TOKEN_VALUES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TOKENS))


@query(f"""
WITH tokens(pos, token) AS (VALUES {_TOKEN_VALUES}), terms AS (SELECT DISTINCT p_name AS term FROM part),
aliases AS (SELECT p_type AS alias, min(p_name) AS term FROM part GROUP BY 1),
forms AS (SELECT pos, token, token AS form, 0 AS step FROM tokens UNION ALL SELECT pos, token, substr(token, 1, length(token) - 1), 1 FROM tokens WHERE ends_with(token, 's') AND length(token) > 2),
hits AS (SELECT pos, token, f.step * 2 AS prio, CASE WHEN step = 0 THEN 'exact' ELSE 'suffix_strip' END AS kind, t.term FROM forms f JOIN terms t ON t.term = f.form
  UNION ALL SELECT pos, token, f.step * 2 + 1, CASE WHEN step = 0 THEN 'alias' ELSE 'suffix_strip' END, a.term FROM forms f JOIN aliases a ON a.alias = f.form),
best AS (SELECT pos, arg_min(kind, prio) AS kind, arg_min(term, prio) AS term FROM hits GROUP BY pos),
fuzzy AS (SELECT t.pos, k.term, {_similarity('t.token', 'k.term')} AS sim FROM tokens t CROSS JOIN terms k WHERE t.pos NOT IN (SELECT pos FROM best)),
top AS (SELECT pos, term, row_number() OVER (PARTITION BY pos ORDER BY sim DESC, term) AS rn FROM fuzzy WHERE sim >= 0.35)
SELECT t.pos, t.token, coalesce(b.kind, 'none') AS kind, b.term, (SELECT string_agg(term, '|' ORDER BY rn) FROM top WHERE top.pos = t.pos AND rn <= 5) AS suggestions
FROM tokens t LEFT JOIN best b USING (pos)""")
def resolve_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to terms: exact, alias, then without a suffix; suggestions for the rest. At most 32 tokens, so the fuzzy side is bounded."""
    part = table(spark, sf_dir, "part")
    terms, aliases = part.select(F.col("p_name").alias("term")).distinct(), part.groupBy(F.col("p_type").alias("form")).agg(F.min("p_name").alias("term"))
    tokens = spark.createDataFrame(list(enumerate(TOKENS)), "pos int, token string")
    stripped = T.strip_suffix(F.col("token"), ["s"])
    forms = tokens.select("pos", "token", F.explode(F.array(F.struct(F.col("token").alias("form"), F.lit(0).alias("step")), F.struct(stripped.alias("form"), F.lit(1).alias("step")))).alias("f")).select("pos", "token", "f.*").filter("form IS NOT NULL")
    kind = lambda name: F.when(F.col("step") == 0, F.lit(name)).otherwise(F.lit("suffix_strip")).alias("kind")
    exact = forms.join(terms.withColumnRenamed("term", "form"), "form").select("pos", (F.col("step") * 2).alias("prio"), kind("exact"), F.col("form").alias("term"))
    alias = aliases.join(F.broadcast(forms), "form").select("pos", (F.col("step") * 2 + 1).alias("prio"), kind("alias"), "term")
    best = exact.unionByName(alias).groupBy("pos").agg(F.min(F.struct("prio", "kind", "term")).alias("b")).select("pos", "b.kind", "b.term")
    open_ = tokens.join(best, "pos", "left_anti").withColumn("grams", T.trigrams(F.col("token")))
    fuzzy = terms.withColumn("own", T.trigrams(F.col("term"))).join(F.broadcast(open_), F.arrays_overlap("own", "grams")).withColumn("sim", T.jaccard(F.col("own"), F.col("grams"))).filter("sim >= 0.35")
    nth = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("sim"), "term"))
    top = fuzzy.withColumn("rn", nth).filter("rn <= 5").groupBy("pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]), "|").alias("suggestions"))
    return tokens.join(best, "pos", "left").join(top, "pos", "left").select("pos", "token", F.coalesce("kind", F.lit("none")).alias("kind"), "term", "suggestions")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the region, nation, supplier and customer tables."""
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(F.col("n_nationkey").cast("long").alias("edge_id"), F.lit("PART_OF").alias("type"), key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(supplier.select((F.col("s_suppkey") + 1_000_000).alias("edge_id"), F.lit("RELATED_TO").alias("type"), key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit(0.5).alias("weight")))
    edges = edges.unionByName(customer.select((F.col("c_custkey") + 100_000_000).alias("edge_id"), F.lit("HAS_TOPIC").alias("type"), key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit(0.25).alias("weight")))
    nodes = nation.select(key("n", "n_nationkey").alias("nk")).unionByName(supplier.select(key("s", "s_suppkey").alias("nk"))).unionByName(customer.select(key("c", "c_custkey").alias("nk"))).unionByName(nation.select(key("r", "n_regionkey").alias("nk")).distinct())
    return nodes, edges


_EDGES_SQL = """edges AS (SELECT n_nationkey::BIGINT AS id, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 1.0 AS w FROM nation
  UNION ALL SELECT s_suppkey + 1000000, 's' || s_suppkey, 'n' || s_nationkey, 0.5 FROM supplier UNION ALL SELECT c_custkey + 100000000, 'c' || c_custkey, 'n' || c_nationkey, 0.25 FROM customer),
steps AS (SELECT id, src AS a, dst AS b, w FROM edges UNION ALL SELECT id, dst, src, w FROM edges)"""


@query(f"""
WITH {_EDGES_SQL}, seeds(nk) AS (VALUES ('r0'), ('n3'), ('n5')),
h1 AS (SELECT nk AS seed, b AS node, w, id AS i1 FROM seeds JOIN steps ON a = nk),
h2 AS (SELECT seed, b AS node, h1.w + s.w AS w FROM h1 JOIN steps s ON s.a = h1.node AND s.id <> i1),
hits AS (SELECT seed, node, w FROM h1 UNION ALL SELECT seed, node, w FROM h2),
sums AS (SELECT node AS topic, count(DISTINCT seed) AS overlap, CAST(sum(w) AS DOUBLE) AS weight FROM hits WHERE node <> seed AND substr(node, 1, 1) IN ('s', 'c') GROUP BY 1)
SELECT topic, overlap, round(weight, 6) AS weight, CAST(round((overlap * 10 + least(weight, 5)) * CASE WHEN substr(topic, 1, 1) = 's' THEN 1.0 ELSE 0.5 END, 6) AS DOUBLE) AS score
FROM sums ORDER BY score DESC, overlap DESC, weight DESC, topic LIMIT 100""")
def graph_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds to ranked topics over trails of up to two edges."""
    nodes, edges = _graph(spark, sf_dir)
    seeds = spark.createDataFrame([("r0",), ("n3",), ("n5",)], "nk string")
    topics = nodes.filter(F.substring("nk", 1, 1).isin("s", "c"))
    ranked = graph.rank(graph.trail_sums(F.broadcast(seeds), edges, topics), topics.withColumn("is_leaf", F.startswith("nk", F.lit("s"))))
    return ranked.select("topic", "overlap", F.round("weight", 6).alias("weight"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), F.desc("overlap"), F.desc("weight"), "topic").limit(100)


@query(f"""
WITH RECURSIVE {_EDGES_SQL}, walk(nk, hops) AS (SELECT 's0', 0 UNION SELECT b, hops + 1 FROM walk JOIN steps ON a = nk WHERE hops < 4)
SELECT nk, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY nk""")
def shortest_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest hops from one node to all within four."""
    return graph.distances(spark.createDataFrame([("s0",)], "nk string"), _graph(spark, sf_dir)[1], 4).select("nk", "hops")


@query("""
WITH RECURSIVE parents AS (SELECT 'n' || n_nationkey AS nk, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
up(nk, ancestor, depth) AS (SELECT nk, parent, 1 FROM parents UNION ALL SELECT u.nk, p.parent, depth + 1 FROM up u JOIN parents p ON p.nk = u.ancestor)
SELECT nk, ancestor, CAST(depth AS INTEGER) AS depth FROM up""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of parents to the root."""
    edges = _graph(spark, sf_dir)[1].filter("type <> 'HAS_TOPIC'")
    return graph.ancestors(edges.select(F.col("src").alias("nk"), F.col("dst").alias("parent")))


@query(f"""WITH {_EDGES_SQL}, near AS (
 SELECT 'n0' AS anchor, b AS topic, row_number() OVER (ORDER BY b) AS place FROM steps WHERE a = 'n0' AND substr(b, 1, 1) IN ('s', 'c')
 )
SELECT anchor, topic, 1 AS hops FROM near WHERE place <= 25""")
def topic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with content next to an anchor, the first 25."""
    nodes, edges = _graph(spark, sf_dir)
    topics = nodes.withColumn("content", F.when(F.substring("nk", 1, 1).isin("s", "c"), 1).otherwise(0))
    return graph.gated_neighbours(spark.createDataFrame([("n0",)], "nk string"), edges.filter("type <> 'PART_OF'"), topics)


@query(f"WITH {_EDGES_SQL} SELECT a AS nk, count(DISTINCT id) AS degree FROM steps GROUP BY 1")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_graph(spark, sf_dir)[1])


@query("""SELECT o_orderpriority AS work, l_partkey AS topic, count(*) AS mentions FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, l_partkey) <= 25""")
def topics_in_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most mentioned topics of each work."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("topic"))
    counts = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("work")), "l_orderkey").groupBy("work", "topic").agg(F.count(F.lit(1)).alias("mentions"))
    nth = F.row_number().over(Window.partitionBy("work").orderBy(F.desc("mentions"), "topic"))
    return counts.withColumn("rn", nth).filter("rn <= 25").drop("rn")


@query("""WITH m AS (SELECT l_partkey AS topic, l_suppkey AS work, l_orderkey AS verse FROM lineitem WHERE l_partkey < 50),
v AS (SELECT topic, work, verse, row_number() OVER (PARTITION BY topic, work ORDER BY verse) AS rn FROM (SELECT DISTINCT * FROM m))
SELECT topic, work, (SELECT count(*) FROM m x WHERE x.topic = v.topic AND x.work = v.work) AS mentions, string_agg(verse::VARCHAR, ',' ORDER BY verse) AS verses FROM v WHERE rn <= 10 GROUP BY 1, 2""")
def works_for_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that mention one of the first topics, with their first ten verses."""
    return _works(table(spark, sf_dir, "lineitem").filter("l_partkey < 50"))


@query("""WITH m AS (SELECT l_partkey AS topic, l_suppkey AS work, l_orderkey AS verse FROM lineitem),
c AS (SELECT topic, work, count(*) AS mentions FROM m GROUP BY 1, 2),
v AS (SELECT topic, work, verse, row_number() OVER (PARTITION BY topic, work ORDER BY verse) AS rn FROM (SELECT DISTINCT * FROM m))
SELECT topic, work, any_value(mentions) AS mentions, string_agg(verse::VARCHAR, ',' ORDER BY verse) AS verses FROM v JOIN c USING (topic, work) WHERE rn <= 10 GROUP BY 1, 2""")
def works_for_every_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that mention a topic, with their first ten verses, for all topics."""
    return _works(table(spark, sf_dir, "lineitem"))


def _works(mentions: DataFrame) -> DataFrame:
    """The first verses are kept by a limit of each group, so that no group is gathered whole; mentions are summed from those of a verse."""
    each = mentions.groupBy(F.col("l_partkey").alias("topic"), F.col("l_suppkey").alias("work"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    first = each.withColumn("rn", F.row_number().over(Window.partitionBy("topic", "work").orderBy("l_orderkey"))).filter("rn <= 10")
    rows = first.groupBy("topic", "work").agg(F.sort_array(F.collect_list("l_orderkey")).alias("v"))
    counts = each.groupBy("topic", "work").agg(F.sum("n").alias("mentions"))
    return rows.join(counts, ["topic", "work"]).select("topic", "work", "mentions", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("verses"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey) b ON o_custkey = c_custkey""")
def best_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best child of each parent (DISTINCT ON), combined before the shuffle."""
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey", "o_totalprice")).alias("b"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", "b.o_orderkey", "b.o_totalprice")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next row within a parent."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_name ILIKE '%00%' AND c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_name ILIKE '%00%' AND c_mktsegment = 'BUILDING' ORDER BY c_name OFFSET 20 LIMIT 20")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered page with the total."""
    rows = table(spark, sf_dir, "customer").filter((F.col("c_mktsegment") == "BUILDING") & T.literal_like(F.col("c_name"), "00")).select("c_custkey", "c_name")
    return rows.orderBy("c_name").offset(20).limit(20).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


@query(f"""SELECT kind, key, round(score, 6) AS score FROM (
 SELECT 'term' AS kind, p_name AS key, {_similarity('p_name', "'old gear'")} AS score FROM (SELECT DISTINCT p_name FROM part)
 UNION ALL SELECT 'nation', n_name, {_similarity('n_name', "'old gear'")} FROM nation) WHERE score >= 0.3 ORDER BY score DESC, key LIMIT 20""")
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed hits of several tables in one ranking."""
    hits = table(spark, sf_dir, "part").select(F.lit("term").alias("kind"), F.col("p_name").alias("key")).distinct().unionByName(table(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("key")))
    scored = hits.withColumn("score", F.round(T.trigram_similarity(F.col("key"), F.lit("old gear")), 6)).filter("score >= 0.3")
    return scored.orderBy(F.desc("score"), "key").limit(20)


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))), ',') AS sources
FROM (SELECT c_custkey AS k, c_acctbal AS v, ['old'] AS s FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, c_acctbal + 1 AS v, ['new'] AS s FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old ones by key, provenance united."""
    rows = table(spark, sf_dir, "customer")
    old = rows.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.array(F.lit("old")).alias("sources"))
    new = rows.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"), F.array(F.lit("new")).alias("sources"))
    return merge.upsert(old, new, "k").withColumn("sources", F.array_join("sources", ","))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a,b' END AS left_sources FROM customer WHERE c_custkey % 5 <> 0")
def source_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source alone go, co-owned rows lose it."""
    s = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("x"))).when(F.col("c_custkey") % 2 == 0, F.array(F.lit("b"), F.lit("x"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return merge.clear_source(table(spark, sf_dir, "customer").select("c_custkey", s.alias("sources")), "x").select("c_custkey", F.array_join("sources", ",").alias("left_sources"))


@query("SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each identity."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("first_order"))
    return merge.keep_first(rows, ["l_partkey", "l_suppkey"], [F.col("first_order")])


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1), ' ') AS links, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets and heading of each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.links(F.col("html")), " ").alias("links"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))


@query("SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, count(*) FILTER (WHERE trim(text, ' ') <> '' AND role <> 'system') AS shown, string_agg(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END, '|' ORDER BY turn) AS texts FROM conversations GROUP BY 1""")
def hydrate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a document in order, capped at 100 code points, and how many can be shown."""
    return _hydrated(spark, sf_dir, lambda x: T.capped(x, 100))


@query("""SELECT conv_id, count(*) FILTER (WHERE trim(text, ' ') <> '' AND role <> 'system') AS shown, string_agg(CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '…' ELSE text END, '|' ORDER BY turn) AS texts FROM conversations GROUP BY 1""")
def hydrate_long_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a document in order, with the operator's own cap, and how many can be shown."""
    return _hydrated(spark, sf_dir, T.capped)


def _hydrated(spark: SparkSession, sf_dir: str, cap: Callable[[Column], Column]) -> DataFrame:
    blocks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("b"))
    shown = F.size(F.filter("b", lambda x: (F.trim(x["text"]) != "") & (x["role"] != "system"))).cast("long")
    return blocks.select("conv_id", shown.alias("shown"), F.array_join(F.transform("b", lambda x: cap(x["text"])), "|").alias("texts"))


@query("""SELECT o_orderpriority AS section, min(o_orderkey) AS first_seen, arg_min(o_custkey, o_orderkey) AS first_parent, arg_max(o_custkey, o_orderkey) AS last_parent, count(*) AS n FROM orders GROUP BY 1""")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last member of each section, in order of first sight."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("section")).agg(F.min("o_orderkey").alias("first_seen"), F.min_by("o_custkey", "o_orderkey").alias("first_parent"), F.max_by("o_custkey", "o_orderkey").alias("last_parent"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def counts_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of two kinds for each parent; none counts 0."""
    one = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    two = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(one, "n_nationkey", "left").join(two, "n_nationkey", "left").fillna(0, ["customers", "suppliers"])


@query("SELECT event_id, ts, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM events")
def preceding_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last primary row before each row, and a running number."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", "ts", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("last_view"), F.count(F.lit(1)).over(w).alias("place"))


@query("""SELECT doc_id, item_id, CAST(min(strpos(d.text, b.text)) AS BIGINT) - 1 AS char_start, CAST(min(strpos(d.text, b.text)) + length(any_value(b.text)) AS BIGINT) - 1 AS char_end FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1, 2""")
def locate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages found verbatim in documents, with offsets.

    Both sides are blocked by the hash of three words: of the passage its second to fourth, of the documents all. Only
    documents that share one are searched. Passages of fewer than five words are sought in every document.
    """
    words = lambda c: F.split(c, r"[\x20\n]+")
    every = table(spark, sf_dir, "benchmark").withColumn("w", words(F.col("text")))
    short = every.filter(F.size("w") < 5).select("item_id", F.col("text").alias("passage"))
    items = every.filter(F.size("w") >= 5).select("item_id", F.col("text").alias("passage"), F.xxhash64(F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3))).alias("h"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("w", words(F.col("text")))
    keys = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    # Only ids and hashes are joined to the passages; the texts of those that share one are fetched afterwards.
    pairs = docs.select("doc_id", F.explode(F.array_distinct(keys)).alias("h")).join(items, "h").select("doc_id", "item_id", "passage").distinct()
    found = docs.select("doc_id", "text").join(pairs, "doc_id").filter(F.contains("text", F.col("passage")))
    start = F.position("passage", "text")
    found = found.unionByName(docs.select("doc_id", "text").join(F.broadcast(short), F.contains("text", F.col("passage"))).select("doc_id", "text", "item_id", "passage"))
    return found.select("doc_id", "item_id", (start - 1).cast("long").alias("char_start"), (start - 1 + F.length("passage")).cast("long").alias("char_end")).distinct()


@query("SELECT p_partkey, substr(sha1('part:' || p_partkey), 1, 24) AS id, 'part:' || lpad(p_partkey::VARCHAR, 5, '0') AS padded, 'part:' || p_partkey AS canonical FROM part")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ids, and keys without the zeros of their numbers.

    The padded key is shown as in the SQL, whose lpad cuts longer numbers to five digits; the canonical one is of the whole number.
    """
    number = F.col("p_partkey").cast("string")
    padded, whole = (F.concat(F.lit("part:"), F.lpad(number, width, F.lit("0"))) for width in (F.lit(5), F.greatest(F.lit(5), F.length(number))))
    return table(spark, sf_dir, "part").select("p_partkey", T.document_id(F.concat(F.lit("part:"), number)).alias("id"), padded.alias("padded"), T.canonical_key(whole).alias("canonical"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1, 2")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity by kind and hour."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


@query("SELECT upper(substr(c_name, 1, 1)) AS letter, count(*) AS n FROM customer GROUP BY 1")
def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-letter histogram."""
    return table(spark, sf_dir, "customer").groupBy(F.upper(F.substring("c_name", 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@query()
def align_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in documents, spelled alike or nearly: all pairs of a passage and a document that can match are aligned."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("target"))
    pairs = alignment.candidates(docs, [tuple(r) for r in items.collect()], "item_id", dict(items.dtypes)["item_id"])
    return alignment.align(pairs).filter("status = 'matched'").select("doc_id", "item_id", "method", F.round("score", 6).alias("score"), "char_start", "char_end")


def _plain(x: str) -> str:
    """SQL for the normal form of a text without Devanagari."""
    return f"regexp_replace(nfc_normalize({x}), '[" + (alignment.REMOVED + "0-9\u0966-\u096f").replace("'", "''") + "]+', '', 'g')"


@query(f"""WITH d AS (SELECT doc_id, {_plain('text')} AS t FROM documents), b AS (SELECT item_id, {_plain('text')} AS p FROM benchmark)
SELECT DISTINCT doc_id, item_id, 1.0::DOUBLE AS score FROM d JOIN b ON contains(t, p) WHERE p <> ''""")
def aligned_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of align_passages whose normal forms contain each other, whatever their punctuation, digits and spaces."""
    return align_passages(spark, sf_dir).filter("method = 'exact_normalized'").select("doc_id", "item_id", "score").distinct()


@query()
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, blocks, links and table cells of every page."""
    return html.page_rows(table(spark, sf_dir, "pages"))


@query(f"""SELECT * FROM (SELECT p_name, greatest(whole, part) AS score, CASE WHEN whole >= part THEN 'name' ELSE 'part' END AS badge FROM (SELECT p_name, round({sql_similarity('p_name', f"'{PHRASE}'")}, 6) AS whole, round({sql_word_similarity(PHRASE, 'p_name')}, 6) AS part FROM (SELECT DISTINCT p_name FROM part))
WHERE whole >= 0.25 OR part >= 0.5) ORDER BY score DESC, p_name LIMIT 50""")
def fuzzy_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by a part of their name: whole names from 0.25, parts from 0.5; the better of the two, and which it is."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    whole, part = T.trigram_similarity(F.col("p_name"), F.lit(PHRASE)), T.word_similarity(F.lit(PHRASE), F.col("p_name"))
    scored = names.withColumn("whole", F.round(whole, 6)).withColumn("part", F.round(part, 6)).filter("whole >= 0.25 OR part >= 0.5")
    return scored.select("p_name", F.greatest("whole", "part").alias("score"), F.when(F.col("whole") >= F.col("part"), "name").otherwise("part").alias("badge")).orderBy(F.desc("score"), "p_name").limit(50)


@query("""SELECT user_id, max(n) AS most, count(*) AS hours FROM (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def busiest_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the hours with any activity and the most events in one."""
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("user_id").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("hours"))


FLAGSHIP = graph_rank
