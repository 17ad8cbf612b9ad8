"""Queries that read and walk the graph, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import graph
from textloom.plans.base import keyed, query, table
from textloom.plans.retrieval import KNOWLEDGE_SQL, knowledge

STARTS = ["s1", "s2", "n4", "s8"]
_STARTS = ", ".join(f"('{s}')" for s in STARTS)


def _starts(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "nk string")


def _trails(direction: str, order: int, types: str, ends: list[tuple[str, str]], depth: int) -> str:
    """SQL of trails in one direction: (start, at, type, w) of the first edge, with all edges different."""
    steps = " UNION ALL ".join(f"SELECT id, type, coalesce(w, 1.0) AS w, {a} AS a, {b} AS b FROM edges WHERE type IN ({types})" for a, b in ends)
    out = [f"{direction}_s AS ({steps})", f"{direction}_1 AS (SELECT nk AS start, b AS here, type, w, [id] AS ids FROM starts JOIN {direction}_s ON a = nk)"]
    out += [f"{direction}_{k} AS (SELECT start, s.b AS here, t.type, t.w, list_append(ids, s.id) AS ids FROM {direction}_{k - 1} t JOIN {direction}_s s ON s.a = t.here AND NOT list_contains(ids, s.id))" for k in range(2, depth + 1)]
    union = " UNION ALL ".join(f"SELECT start, here AS nk, {order} AS o, type, -w AS light, '{direction}' AS direction FROM {direction}_{k} WHERE here <> start" for k in range(1, depth + 1))
    return ", ".join(out) + f", {direction} AS ({union})"


@query(f"""WITH {KNOWLEDGE_SQL}, starts(nk) AS (VALUES {_STARTS}), {_trails('outbound', 0, "'PART_OF', 'MENTIONS_KEYWORD'", [('src', 'dst')], 3)}, {_trails('inbound', 1, "'PART_OF', 'MENTIONS_KEYWORD'", [('dst', 'src')], 3)}, {_trails('undirected', 2, "'RELATED_TO'", [('src', 'dst'), ('dst', 'src')], 3)},
every AS (SELECT * FROM outbound UNION ALL SELECT * FROM inbound UNION ALL SELECT * FROM undirected),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY start, nk ORDER BY o, type, light) = 1)
SELECT start, nk, type, direction, -light AS weight, is_stub FROM best JOIN nodes USING (nk) WHERE NOT is_stub""")
def typed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What trails of up to three edges of some types reach from several topics: forwards, backwards, and either way."""
    nodes, edges = knowledge(spark, sf_dir)
    return graph.typed_neighbours(_starts(spark, STARTS), edges, nodes, ("PART_OF", "RELATED_TO", "MENTIONS_KEYWORD", "IN_SHASTRA"), 3)


@query(f"""WITH {KNOWLEDGE_SQL}, d AS (SELECT src AS term, dst AS nk, type FROM edges WHERE type IN ('HAS_TOPIC', 'PART_OF') AND src LIKE 'c%' UNION SELECT e.src, f.dst, e.type FROM edges e JOIN edges f ON f.src = e.dst AND f.type IN ('HAS_TOPIC', 'PART_OF') WHERE e.type = 'HAS_TOPIC')
SELECT DISTINCT term, d.nk, type FROM d JOIN nodes ON nodes.nk = d.nk WHERE label = 'topic' AND NOT is_stub""")
def topics_of_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics within two forward edges of every term."""
    nodes, edges = knowledge(spark, sf_dir)
    topics = nodes.filter("label = 'topic' AND NOT is_stub").select("nk")
    near = graph.typed_neighbours(nodes.filter("label = 'keyword'").select("nk"), edges, nodes, ("HAS_TOPIC", "PART_OF"), 2, both_ways=())
    return near.filter("direction = 'outbound'").join(topics, "nk").select(F.col("start").alias("term"), "nk", "type")


@query("""WITH RECURSIVE parents AS (SELECT 's' || s_suppkey AS nk, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'r9' FROM supplier WHERE s_suppkey % 2 = 0),
up(nk, top, chain, n) AS (SELECT nk, parent, parent, 1 FROM parents UNION ALL SELECT u.nk, p.parent, p.parent || '>' || chain, n + 1 FROM up u JOIN parents p ON p.nk = u.top)
SELECT nk, chain FROM up QUALIFY row_number() OVER (PARTITION BY nk ORDER BY n DESC, string_split(chain, '>')) = 1""")
def longest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors of every node from the root down; of several chains the longest."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    parents = supplier.select(keyed("s", "s_suppkey").alias("nk"), keyed("n", "s_nationkey").alias("parent")).unionByName(nation.select(keyed("n", "n_nationkey").alias("nk"), keyed("r", "n_regionkey").alias("parent")))
    parents = parents.unionByName(supplier.filter("s_suppkey % 2 = 0").select(keyed("s", "s_suppkey").alias("nk"), F.lit("r9").alias("parent")))
    return graph.chains(parents).select("nk", F.array_join("chain", ">").alias("chain"))


@query(f"""WITH {KNOWLEDGE_SQL}, pairs AS (SELECT src AS nk, dst AS other, type FROM edges UNION ALL SELECT dst, src, type FROM edges WHERE type = 'RELATED_TO')
SELECT DISTINCT b.type AS relation, b.nk, b.other, label, is_stub FROM pairs b JOIN nodes n ON n.nk = b.other WHERE b.nk <> b.other AND (b.type = 'RELATED_TO' OR b.type IN ('MENTIONS_KEYWORD', 'HAS_TOPIC') AND NOT is_stub)""")
def related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related nodes either way, with stubs; mentioned terms and topics without."""
    nodes, edges = knowledge(spark, sf_dir)
    related = edges.filter("type = 'RELATED_TO'")
    pairs = edges.filter("type IN ('RELATED_TO', 'MENTIONS_KEYWORD', 'HAS_TOPIC')").select(F.col("type").alias("relation"), F.col("src").alias("nk"), F.col("dst").alias("other"))
    pairs = pairs.unionByName(related.select(F.col("type").alias("relation"), F.col("dst").alias("nk"), F.col("src").alias("other"))).filter("nk <> other").distinct()
    found = pairs.join(nodes.select(F.col("nk").alias("other"), "label", "is_stub"), "other")
    return found.filter("relation = 'RELATED_TO' OR NOT is_stub").select("relation", "nk", "other", "label", "is_stub")


@query(f"""WITH RECURSIVE {KNOWLEDGE_SQL}, anyway AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk(nk, n) AS (SELECT 'c3', 0 UNION SELECT b, n + 1 FROM walk JOIN anyway ON a = nk WHERE n < 6),
level AS (SELECT nk, min(n) AS n FROM walk GROUP BY 1),
via AS (SELECT l.nk, l.n, min(p.nk) AS via FROM level l LEFT JOIN anyway ON b = l.nk LEFT JOIN level p ON p.nk = a AND p.n = l.n - 1 GROUP BY 1, 2),
back(nk, n) AS (SELECT nk, n FROM via WHERE nk = 'c10' UNION ALL SELECT v.via, v.n - 1 FROM back JOIN via v ON v.nk = back.nk AND v.n = back.n WHERE v.n > 0)
SELECT CAST(n AS INTEGER) AS place, nk FROM back""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a shortest path between two nodes."""
    return graph.shortest_path(knowledge(spark, sf_dir)[1], "c3", "c10")


#: What labels are shown as.
KINDS = {"topic": "topic", "keyword": "keyword", "shastra": "shastra", "gatha": "gatha", "teeka": "teeka", "publication": "publication", "gathateeka": "gatha_teeka", "gathateekabhaavarth": "bhaavarth", "kalashbhaavarth": "bhaavarth", "kalash": "kalash", "page": "page", "table": "table"}


def _payload(spark: SparkSession, sf_dir: str, focus: str, depth: int, most: int) -> DataFrame:
    nodes, edges = knowledge(spark, sf_dir)
    stub = nodes.filter("is_stub").select("nk")
    shown = edges.join(stub.select(F.col("nk").alias("src")), "src", "left_anti").join(stub.select(F.col("nk").alias("dst")), "dst", "left_anti")
    start = _starts(spark, [focus])
    kept = graph.subgraph(start, shown, depth, most)
    found = graph.payload_nodes(kept, start).join(nodes, "nk")
    return found.select("nk", T.kind_of(F.lower("label"), KINDS).alias("kind"), T.display(F.lit(""), F.lit(None), F.upper("nk")).alias("title"), "degree")


@query(f"""WITH {KNOWLEDGE_SQL}, good AS (SELECT * FROM edges WHERE src NOT IN (SELECT nk FROM nodes WHERE is_stub) AND dst NOT IN (SELECT nk FROM nodes WHERE is_stub)),
anyway AS (SELECT src AS a, dst AS b FROM good UNION SELECT dst, src FROM good), lv AS (SELECT 's1' AS nk, 0 AS n UNION SELECT b, 1 FROM anyway WHERE a = 's1'), near AS (SELECT nk, min(n) AS n FROM lv GROUP BY 1),
kept AS (SELECT e.* FROM good e JOIN (SELECT id, min(n) AS hop FROM good JOIN near ON nk IN (src, dst) GROUP BY 1) h USING (id) ORDER BY hop, id LIMIT 40),
ends AS (SELECT src AS nk FROM kept UNION ALL SELECT dst FROM kept)
SELECT nk, label AS kind, upper(nk) AS title, count(*) AS degree FROM ends JOIN nodes USING (nk) GROUP BY ALL""")
def expand_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the edges within two hops of a node, without stubs, with kinds, titles and degrees."""
    return _payload(spark, sf_dir, "s1", 2, 40)


@query(f"""WITH {KNOWLEDGE_SQL}, kept AS (SELECT * FROM edges WHERE src IN (SELECT nk FROM nodes) AND dst IN (SELECT nk FROM nodes) ORDER BY id LIMIT 120)
SELECT src || '|' || type || '|' || dst AS id, src, dst, type AS kind, coalesce(w, 1.0) AS weight FROM kept""")
def landing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edges of the graph between nodes of known labels."""
    nodes, edges = knowledge(spark, sf_dir)
    known = nodes.filter(F.lower("label").isin(*KINDS)).select("nk")
    kept = edges.join(known.select(F.col("nk").alias("src")), "src", "left_semi").join(known.select(F.col("nk").alias("dst")), "dst", "left_semi").orderBy("edge_id").limit(120)
    return kept.select(F.concat_ws("|", "src", "type", "dst").alias("id"), "src", "dst", F.col("type").alias("kind"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


SEEDS = ["x1", "x2", "s1", "s4"]


@query(f"""WITH {KNOWLEDGE_SQL}, seeds(place, nk) AS (VALUES (0, 'x1'), (1, 'x2'), (2, 's1'), (3, 's4'))
SELECT nk AS seed, count(DISTINCT id) AS edges FROM seeds JOIN edges ON nk IN (src, dst) GROUP BY nk, place ORDER BY place LIMIT 1""")
def first_landing_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of at most four seeds that has edges; a caller shuffles the seeds."""
    edges = knowledge(spark, sf_dir)[1].select("edge_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("seed"))
    seeds = spark.createDataFrame(list(enumerate(SEEDS[:4])), "place int, seed string")
    counts = edges.join(F.broadcast(seeds), "seed").groupBy("place", "seed").agg(F.countDistinct("edge_id").alias("edges"))
    return counts.orderBy("place").limit(1).select("seed", "edges")


@query(f"""WITH {KNOWLEDGE_SQL}, stubs AS (SELECT 'c' || c_custkey AS nk, c_acctbal AS made FROM customer WHERE c_custkey % 11 = 0)
SELECT nk, label, (SELECT count(*) FROM stubs) AS total FROM stubs JOIN nodes USING (nk) ORDER BY made DESC NULLS FIRST, nk LIMIT 20 OFFSET 5""")
def stub_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the stubs of one label, newest first, with their total."""
    nodes = knowledge(spark, sf_dir)[0]
    made = table(spark, sf_dir, "customer").select(keyed("c", "c_custkey").alias("nk"), F.col("c_acctbal").alias("at"))
    stubs = nodes.filter("is_stub AND label = 'keyword'").join(made, "nk")
    page = stubs.orderBy(F.desc_nulls_first("at"), "nk").offset(5).limit(20).select("nk", "label")
    return page.crossJoin(F.broadcast(stubs.agg(F.count(F.lit(1)).alias("total"))))


@query(f"""WITH {KNOWLEDGE_SQL}, pairs AS (SELECT src AS term, dst AS topic FROM edges WHERE type = 'HAS_TOPIC' UNION SELECT e.src, p.src FROM edges e JOIN edges p ON p.dst = e.dst AND p.type = 'PART_OF' WHERE e.type = 'HAS_TOPIC')
SELECT topic, count(DISTINCT term) AS overlap, CAST(count(*) AS DOUBLE) AS weight FROM pairs GROUP BY 1""")
def topic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms name a topic or the topic that it is a part of; a pair counts once."""
    counts = graph.term_counts(knowledge(spark, sf_dir)[1])
    return counts.select("topic", F.col("terms").alias("overlap"), F.col("terms").cast("double").alias("weight"))


@query(f"""WITH {KNOWLEDGE_SQL} SELECT label, is_stub, count(*) AS nodes, count(*) FILTER (WHERE is_leaf) AS leaves, CAST(sum(content) AS BIGINT) AS content FROM nodes GROUP BY 1, 2""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by label, real or stub, with leaves and content."""
    return knowledge(spark, sf_dir)[0].groupBy("label", "is_stub").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.sum("content").cast("long").alias("content"))


@query(f"""WITH {KNOWLEDGE_SQL} SELECT label, coalesce(sum(CASE WHEN type = 'PART_OF' THEN 1 END), 0)::BIGINT AS part_of, coalesce(sum(CASE WHEN type = 'RELATED_TO' THEN 1 END), 0)::BIGINT AS related_to, coalesce(sum(CASE WHEN type = 'HAS_TOPIC' THEN 1 END), 0)::BIGINT AS has_topic FROM edges JOIN nodes ON nk = src GROUP BY 1""")
def edge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type, as columns, for each label of their source."""
    nodes, edges = knowledge(spark, sf_dir)
    typed = edges.join(nodes.select(F.col("nk").alias("src"), "label"), "src").groupBy("label").pivot("type", ["PART_OF", "RELATED_TO", "HAS_TOPIC"]).agg(F.count(F.lit(1)))
    return typed.select("label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in ("PART_OF", "RELATED_TO", "HAS_TOPIC")])
