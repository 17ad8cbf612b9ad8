"""Sinks and maintenance of stored tables: merges by key, stubs and edges, placeholders, aliases, cascades, reports.

Tables are Parquet folders. A merge reads the old table, writes the new one beside it, and then swaps the two through
Spark's own file system, so that a job that dies leaves the old table whole. Null keys are refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import merge

EDGE_IDENTITY = ["type", "src", "dst", "block_index", "section_index", "definition_index"]
#: Types of edges that may be written, and those that may be set by hand.
EDGE_TYPES = ("IS_A", "PART_OF", "RELATED_TO", "ALIAS_OF", "MENTIONS_KEYWORD", "HAS_TOPIC", "MENTIONS_TOPIC", "CONTAINS_DEFINITION", "HAS_TEEKA", "HAS_PUBLICATION", "IN_SHASTRA", "IN_TEEKA", "IN_PUBLICATION", "CONTAINS_TABLE", "MENTIONS_TABLE")


def swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a new table in the place of the one at a path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path}-old-{uuid.uuid4().hex}")
    had = fs.exists(at)
    if had:
        fs.rename(at, old)
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), at)
    if had:
        fs.delete(old, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def beside(rows: DataFrame, path: str) -> str:
    """Write rows next to the table at a path; returns where."""
    fresh = f"{path}-new-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    return fresh


def overwrite(rows: DataFrame, path: str) -> DataFrame:
    """Write rows as the table at a path, also if they are read from it."""
    swap(rows.sparkSession, beside(rows, path), path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str, sources: str = "sources", keep_old: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Merge rows into the table at a path by key (see merge.upsert); the table is made if it is not there."""
    if not new.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"rows without {key}")
    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    return overwrite(merge.upsert(old, new.select(*old.columns), key, sources, tuple(c for c in keep_old if c in old.columns)), path)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after new ones arrived: one for each EDGE_IDENTITY, -1 for an index that does not apply; new properties win.

    Of repeated new edges the one with the greatest properties stays.
    """
    bad = new.filter(~F.col("type").isin(*EDGE_TYPES))
    if not bad.isEmpty():
        raise ValueError(f"unknown type of edge: {bad.first()['type']}")
    rest = [c for c in old.columns if c not in EDGE_IDENTITY]
    filled = lambda e: e.select("type", "src", "dst", *[F.coalesce(c, F.lit(-1)).alias(c) for c in EDGE_IDENTITY[3:]], *rest)
    both = filled(old).withColumn("age", F.lit(0)).unionByName(filled(new).withColumn("age", F.lit(1)))
    last = both.groupBy(*EDGE_IDENTITY).agg(F.max(F.struct("age", *rest)).alias("x"))
    return last.select(*EDGE_IDENTITY, *[F.col(f"x.{c}").alias(c) for c in rest])


def edge_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (nk, is_stub, stub_source) with a stub for each end of an edge that is not there yet."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("nk")).distinct()
    fresh = ends.join(nodes, "nk", "left_anti").select("nk", F.lit(True).alias("is_stub"), F.lit("edge").alias("stub_source"))
    return nodes.unionByName(fresh, allowMissingColumns=True)


def prefer_real(rows: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """One row of each identity: a real one goes before a stub, then the first by the order."""
    first = F.row_number().over(Window.partitionBy(*identity).orderBy(F.coalesce("is_stub", F.lit(False)), *order))
    return rows.withColumn("n__", first).filter("n__ = 1").drop("n__")


def resolve_placeholders(nodes: DataFrame, edges: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges whose placeholders are replaced by real keys, and the placeholders (nk) that were.

    A placeholder is a stub with parent_keyword and topic_path; topics (nk, parent_keyword, topic_path) are real. Of several
    topics the least key is taken; a placeholder without one stays.
    """
    real = topics.groupBy("parent_keyword", "topic_path").agg(F.min("nk").alias("real"))
    found = nodes.filter("is_stub AND parent_keyword <> '' AND topic_path <> ''").join(real, ["parent_keyword", "topic_path"]).select("nk", "real").filter("nk <> real").distinct()
    moved = lambda df, c: df.join(found.select(F.col("nk").alias(c), F.col("real").alias("real__")), c, "left").withColumn(c, F.coalesce("real__", c)).drop("real__")
    kept = nodes.join(found, "nk", "left_anti")
    ends = moved(moved(edges, "src"), "dst").select(*edges.columns).distinct()
    return kept, ends, found.select("nk")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of gone (nk) that are still stubs."""
    stubs = nodes.filter("is_stub").join(gone, "nk", "left_semi").select("nk")
    left = edges.join(stubs.select(F.col("nk").alias("src")), "src", "left_anti").join(stubs.select(F.col("nk").alias("dst")), "dst", "left_anti")
    return nodes.join(stubs, "nk", "left_anti"), left.select(*edges.columns)


def resync(nodes: DataFrame, rows: DataFrame, label: str | None = None) -> DataFrame:
    """Nodes after relational rows (nk, label, display) were written over them; of one label, or all. Nodes without a row stay."""
    scope = rows if label is None else rows.filter(F.col("label") == label)
    fresh = scope.select("nk", F.col("label").alias("new_label"), F.col("display").alias("new_display"))
    both = nodes.join(fresh, "nk", "full_outer")
    known = F.col("new_label").isNotNull()
    return both.select("nk", F.coalesce("new_label", "label").alias("label"), F.when(known, F.col("new_display")).otherwise(F.col("display")).alias("display"), F.when(known, F.lit(False)).otherwise(F.coalesce("is_stub", F.lit(False))).alias("is_stub"))


def add_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with an ALIAS_OF edge for each (alias, term) that has none yet."""
    new = aliases.select(F.lit("ALIAS_OF").alias("type"), F.col("alias").alias("src"), F.col("term").alias("dst")).distinct()
    return edges.unionByName(new.join(edges, ["type", "src", "dst"], "left_anti").select(*edges.columns))


def remove_edges(edges: DataFrame, gone: DataFrame, allowed: tuple[str, ...] = ("IS_A", "PART_OF", "RELATED_TO", "MENTIONS_KEYWORD", "ALIAS_OF")) -> DataFrame:
    """Edges without those of gone (type, src, dst); only types that are allowed are removed."""
    return edges.join(gone.filter(F.col("type").isin(*allowed)), ["type", "src", "dst"], "left_anti").select(*edges.columns)


def patched(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the values of changes that are not null; changes without a row are an error."""
    if not changes.join(rows, key, "left_anti").isEmpty():
        raise KeyError("a change has no row")
    new = changes.select(key, *[F.col(c).alias(f"{c}__") for c in changes.columns if c != key])
    return rows.join(new, key, "left").select(*[F.coalesce(f"{c}__", c).alias(c) if f"{c}__" in new.columns else F.col(c) for c in rows.columns])


def replaced_links(bridge: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """The bridge table with all links of the owners of new replaced by theirs."""
    return bridge.join(new.select(owner).distinct(), owner, "left_anti").select(*bridge.columns).unionByName(new.select(*bridge.columns).distinct())


def with_parents(children: DataFrame, parents: DataFrame, parent: str, key: str = "nk", id_: str = "id") -> DataFrame:
    """The children with parent_id, the id of their parent by its key; a child whose parent is not there is an error."""
    known = parents.select(F.col(key).alias(parent), F.col(id_).alias("parent_id"))
    out = children.join(known, parent, "left")
    lost = out.filter(F.col(parent).isNotNull() & F.col("parent_id").isNull())
    if not lost.isEmpty():
        raise KeyError(f"no parent {lost.first()[parent]}")
    return out


def by_depth(rows: DataFrame, most: int = 50) -> DataFrame:
    """The rows (nk, parent) with their depth: 0 without a parent among the rows, so that parents go before children."""
    from textloom.operators import graph

    known = rows.select(F.col("nk").alias("parent"))
    up = rows.select("nk", "parent").join(known, "parent", "left_semi").select("nk", "parent")
    deep = graph.ancestors(up, most).groupBy("nk").agg(F.max("depth").alias("depth"))
    return rows.join(deep, "nk", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def merged_views(views: DataFrame) -> DataFrame:
    """(nk, origins) of nodes (nk, origin) that were loaded from several views, once each."""
    return views.groupBy("nk").agg(F.sort_array(F.collect_set("origin")).alias("origins"))


def collapsed(merged: DataFrame, origin: str) -> DataFrame:
    """The nodes left when a view is closed: it goes from their origins, and those without any go."""
    return merge.clear_source(merged, origin, "origins")


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON in one file; for reports, which are small."""
    rows.coalesce(1).write.mode("overwrite").json(path)
