"""Queries that merge, resolve, clear and rebuild stored data, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import merge, store
from textloom.plans.base import keyed, query, table


@query("""WITH a AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'MENTIONS_TOPIC' ELSE 'CONTAINS_DEFINITION' END AS type, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE -1 END AS bi, l_quantity AS w, l_linestatus = 'O' AS new FROM lineitem)
SELECT type, src, dst, bi AS block_index, -1 AS section_index, -1 AS definition_index, max(w) AS weight, max(new) AS renewed FROM (SELECT *, max(new) OVER (PARTITION BY type, src, dst, bi) AS any_new FROM a) WHERE new = any_new GROUP BY 1, 2, 3, 4""")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after new ones came: one for each type, ends and place of its block; new properties win."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "MENTIONS_TOPIC").otherwise("CONTAINS_DEFINITION")
    none = F.lit(None).cast("int")
    rows = lines.select(kind.alias("type"), keyed("o", "l_orderkey").alias("src"), keyed("p", "l_partkey").alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("block_index"), none.alias("section_index"), none.alias("definition_index"), F.col("l_quantity").alias("weight"), (F.col("l_linestatus") == "O").alias("renewed"))
    return store.merge_edges(rows.filter("NOT renewed"), rows.filter("renewed"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'stub' END AS title, CASE WHEN c_custkey % 2 = 0 THEN false WHEN c_custkey % 3 = 0 THEN true END AS is_stub, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'nj,page' WHEN c_custkey % 2 = 0 THEN 'nj' ELSE 'page' END AS sources FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def merge_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stubs that arrive make new nodes but never change real ones; provenance is united."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    real = rows.filter("id % 2 = 0").select("id", "title", F.lit(False).alias("is_stub"), F.array(F.lit("nj")).alias("sources"))
    stubs = rows.filter("id % 3 = 0").select("id", F.lit("stub").alias("title"), F.lit(True).alias("is_stub"), F.array(F.lit("page")).alias("sources"))
    return merge.merge_stubs(real, stubs, "id").withColumn("sources", F.array_join("sources", ","))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 2 END AS first, count(*) OVER () AS n FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are there stay as they are; only new keys are added."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    old, new = rows.filter("id % 3 = 0").withColumn("first", F.lit(1)), rows.filter("id % 2 = 0").withColumn("first", F.lit(2))
    both = merge.insert_absent(old, new, ["id"])
    return both.crossJoin(F.broadcast(both.agg(F.count(F.lit(1)).alias("n"))))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_size + 100 ELSE p_size END AS size, CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE 'new' END AS created_at FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0""")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are replaced by key, but keep when they were made."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    old = rows.filter("id % 3 = 0").withColumn("created_at", F.lit("old"))
    new = rows.filter("id % 4 = 0").select("id", (F.col("size") + 100).alias("size"), F.lit("new").alias("created_at"))
    return merge.upsert(old, new, "id", keep_old=("created_at",))


def _placeholders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    topics = part.select(keyed("t", "p_partkey").alias("nk"), F.col("p_brand").alias("parent_keyword"), F.col("p_size").cast("string").alias("topic_path"))
    place = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string"))
    nodes = supplier.select(keyed("x", "s_suppkey").alias("nk"), (F.col("s_suppkey") % 5 != 0).alias("is_stub"), place.alias("parent_keyword"), F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") % 50).cast("string")).otherwise("").alias("topic_path"))
    edges = supplier.select(F.lit("RELATED_TO").alias("type"), keyed("n", "s_nationkey").alias("src"), keyed("x", "s_suppkey").alias("dst"))
    return nodes, edges, topics


_FOUND = """topics AS (SELECT p_brand AS kw, CAST(p_size AS VARCHAR) AS path, min('t' || p_partkey) AS "real" FROM part GROUP BY 1, 2),
x AS (SELECT 'x' || s_suppkey AS nk, s_suppkey % 5 <> 0 AS is_stub, 'Brand#' || (s_suppkey % 25) AS kw, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 50 AS VARCHAR) ELSE '' END AS path, 'n' || s_nationkey AS src FROM supplier),
f AS (SELECT x.nk, "real" FROM x JOIN topics USING (kw, path) WHERE is_stub AND path <> '')"""


@query(f"""WITH {_FOUND} SELECT DISTINCT 'RELATED_TO' AS type, src, coalesce("real", x.nk) AS dst FROM x LEFT JOIN f ON f.nk = x.nk""")
def placeholder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after placeholders were replaced by the topics that they stand for."""
    return store.resolve_placeholders(*_placeholders(spark, sf_dir))[1]


@query(f"""WITH {_FOUND} SELECT nk, is_stub FROM x WHERE nk NOT IN (SELECT nk FROM f) AND NOT (is_stub AND path = '')""")
def nodes_without_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after resolved placeholders went, and after stubs without a path were deleted with their edges."""
    nodes, edges, topics = _placeholders(spark, sf_dir)
    kept, moved, _ = store.resolve_placeholders(nodes, edges, topics)
    return store.delete_nodes(kept, moved, kept.filter("topic_path = ''").select("nk"))[0].select("nk", "is_stub")


@query("""SELECT 'c' || c_custkey AS nk, CASE WHEN c_custkey % 2 = 0 THEN 'keyword' ELSE 'topic' END AS label, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_name ELSE 'old' END AS display, NOT (c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AS is_stub FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def resync_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one label rebuilt from their rows; nodes without a row, and other labels, stay."""
    rows = table(spark, sf_dir, "customer").select(keyed("c", "c_custkey").alias("nk"), F.when(F.col("c_custkey") % 2 == 0, "keyword").otherwise("topic").alias("label"), "c_name", "c_custkey")
    nodes = rows.filter("c_custkey % 5 <> 0").select("nk", "label", F.lit("old").alias("display"), F.lit(True).alias("is_stub"))
    return store.resync(nodes, rows.filter("c_custkey % 3 <> 0").select("nk", "label", F.col("c_name").alias("display")), "keyword")


@query("""WITH e AS (SELECT 'ALIAS_OF' AS type, p_type AS src, p_name AS dst FROM part UNION SELECT 'IS_A', p_name, p_brand FROM part UNION SELECT 'HAS_TOPIC', p_brand, p_name FROM part)
SELECT * FROM e WHERE NOT (type = 'IS_A' AND dst = 'Brand#3') UNION SELECT 'ALIAS_OF', 'red', p_name FROM part WHERE contains(p_name, 'red')""")
def alias_and_edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases added, edges of allowed types removed, others kept."""
    part = table(spark, sf_dir, "part")
    edge = lambda kind, a, b: part.select(F.lit(kind).alias("type"), F.col(a).alias("src"), F.col(b).alias("dst"))
    edges = edge("ALIAS_OF", "p_type", "p_name").unionByName(edge("IS_A", "p_name", "p_brand")).unionByName(edge("HAS_TOPIC", "p_brand", "p_name")).distinct()
    added = store.add_aliases(edges, part.filter(F.contains("p_name", F.lit("red"))).select(F.lit("red").alias("alias"), F.col("p_name").alias("term")))
    gone = edges.filter("dst = 'Brand#3' OR src = 'Brand#3'")
    return store.remove_edges(added, gone)


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' ELSE p_type END AS p_type, p_name FROM part""")
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the values that were changed; nulls change nothing."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    changes = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 40, "big").alias("p_type"), F.lit(None).cast("string").alias("p_name"))
    return store.patched(rows, changes, "p_partkey")


@query("""SELECT DISTINCT l_orderkey AS work, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE l_suppkey END AS tag FROM lineitem""")
def replaced_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bridge table with all links of some owners replaced."""
    bridge = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("tag")).distinct()
    new = bridge.filter("work % 2 = 0").select("work", F.lit(1).cast("long").alias("tag"))
    return store.replaced_links(bridge, new, "work")


@query("""SELECT s_name AS nk, s_nationkey AS parent_id, 'NATION_' || s_nationkey AS parent FROM supplier""")
def children_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children with the id of the parent that their key names; a lost parent would be an error."""
    children = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("nk"), keyed("NATION_", "s_nationkey").alias("parent"))
    parents = table(spark, sf_dir, "nation").select(F.col("n_name").alias("nk"), F.col("n_nationkey").alias("id"))
    return store.with_parents(children, parents, "parent").select("nk", "parent_id", "parent")


@query("""SELECT 's' || s_suppkey AS nk, CASE WHEN s_nationkey % 2 = 0 THEN 2 ELSE 1 END AS depth FROM supplier UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END FROM nation UNION ALL SELECT 'r' || r_regionkey, 0 FROM region""")
def parents_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their depth, by which parents go before children; a parent outside the rows does not count."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = region.select(keyed("r", "r_regionkey").alias("nk"), F.lit(None).cast("string").alias("parent"))
    rows = rows.unionByName(nation.select(keyed("n", "n_nationkey").alias("nk"), F.when(F.col("n_nationkey") % 2 == 0, keyed("r", "n_regionkey")).otherwise("outside").alias("parent")))
    rows = rows.unionByName(supplier.select(keyed("s", "s_suppkey").alias("nk"), keyed("n", "s_nationkey").alias("parent")))
    return store.by_depth(rows).select("nk", "depth")


@query("""WITH v AS (SELECT 'n' || c_nationkey AS nk, c_mktsegment AS origin FROM customer), m AS (SELECT nk, list_sort(list_distinct(list(origin))) AS o FROM v GROUP BY 1) SELECT nk, array_to_string(list_filter(o, lambda x: x <> 'BUILDING'), ',') AS origins FROM m WHERE len(list_filter(o, lambda x: x <> 'BUILDING')) > 0""")
def collapsed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of several views, once each, after one view was closed."""
    views = table(spark, sf_dir, "customer").select(keyed("n", "c_nationkey").alias("nk"), F.col("c_mktsegment").alias("origin"))
    return store.collapsed(store.merged_views(views), "BUILDING").withColumn("origins", F.array_join("origins", ","))


@query("""SELECT l_partkey AS nk, min_by(l_orderkey, (l_returnflag = 'N', l_orderkey, l_linenumber)) AS first, bool_and(l_returnflag = 'N') AS is_stub FROM lineitem GROUP BY 1""")
def real_before_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each identity, a real one before a stub."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("nk"), F.col("l_orderkey").alias("first"), "l_linenumber", (F.col("l_returnflag") == "N").alias("is_stub"))
    return store.prefer_real(rows, ["nk"], [F.col("first"), F.col("l_linenumber")]).select("nk", "first", "is_stub")


@query("""SELECT nk, is_stub FROM (SELECT 'n' || n_nationkey AS nk, false AS is_stub FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, true FROM nation UNION ALL SELECT DISTINCT 's' || s_suppkey, true FROM supplier)""")
def stubs_for_edge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, and a stub for every end of an edge that has none."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    nodes = nation.select(keyed("n", "n_nationkey").alias("nk"), F.lit(False).alias("is_stub"), F.lit(None).cast("string").alias("stub_source"))
    edges = nation.select(keyed("n", "n_nationkey").alias("src"), keyed("r", "n_regionkey").alias("dst")).unionByName(supplier.select(keyed("s", "s_suppkey").alias("src"), keyed("n", "s_nationkey").alias("dst")))
    return store.edge_ends(nodes, edges).select("nk", "is_stub")
