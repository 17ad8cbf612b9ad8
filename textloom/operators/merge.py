"""Idempotent merges by key, with provenance; deletions by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, sources: str = "sources", keep_old: tuple[str, ...] = ()) -> DataFrame:
    """The table after new rows replaced or joined old ones by key.

    Values of new rows win where they are not null, but for the columns of keep_old; provenance is the sorted union. A null
    key is a key like any other. Of several new rows with a key the one that is greatest as JSON is taken, and their
    provenance is united, so that a repeated row changes nothing.
    """
    w = Window.partitionBy(key)
    last = F.row_number().over(w.orderBy(F.to_json(F.struct(*new.columns)).desc()))
    new = new.withColumn("n__", last)
    if sources in new.columns:
        new = new.withColumn(sources, F.array_distinct(F.flatten(F.collect_list(sources).over(w))))
    a, b = old.alias("a"), new.filter("n__ = 1").drop("n__").alias("b")
    columns = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    for c in old.columns:
        if c == key:
            continue
        one, two = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == sources:
            none = F.array().cast(dict(old.dtypes)[c])
            columns.append(F.sort_array(F.array_union(F.coalesce(one, none), F.coalesce(two, none))).alias(c))
        else:
            columns.append((F.coalesce(one, two) if c in keep_old else F.coalesce(two, one)).alias(c))
    return a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer").select(*columns)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def merge_stubs(nodes: DataFrame, stubs: DataFrame, key: str = "nk") -> DataFrame:
    """Nodes after stubs arrived: a real node never becomes a stub, and its values stay."""
    return upsert(nodes, stubs, key, keep_old=tuple(c for c in nodes.columns if c not in (key, "sources")))


def clear_source(table: DataFrame, source: str, sources: str = "sources") -> DataFrame:
    """Rows of this source alone go; co-owned rows lose it from their provenance."""
    left = F.array_except(sources, F.array(F.lit(source)))
    return table.withColumn(sources, left).filter(F.size(sources) > 0)


def keep_first(rows: DataFrame, identity: list[str], order: list) -> DataFrame:
    """One row of each identity, the first by the order; a struct minimum, so it is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in identity]
    least = F.min(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *rest)).alias("x")
    return rows.groupBy(*identity).agg(least).select(*identity, *[F.col(f"x.{c}").alias(c) for c in rest])
