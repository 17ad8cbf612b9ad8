"""The registry of queries, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ampersands_only(html: Column) -> Column:
    """Markup in which &amp; is the only character reference; others, which some SQL leaves as they are, stand for themselves."""
    return F.regexp_replace(html, "&(?!amp;)", "&amp;")


def spread(rows: DataFrame, key: str, most: int = 4000) -> DataFrame:
    """Rows that are read from few bytes but take long each, dealt out by their key: at most about ``most`` to a task."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)), key)


def sql_trigrams(x: str) -> str:
    """SQL for the trigram set of a text."""
    words = f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def sql_similarity(a: str, b: str) -> str:
    one, two = sql_trigrams(a), sql_trigrams(b)
    return f"coalesce(CAST(len(list_intersect({one}, {two})) AS DOUBLE) / nullif(len(list_distinct(list_concat({one}, {two}))), 0), 0)"


def sql_word_similarity(phrase: str, text: str) -> str:
    """SQL of the greatest similarity of the phrase's trigrams and a run of the text's."""
    ordered = f"flatten(list_transform(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
    wanted = sql_trigrams(f"'{phrase}'")
    run = f"list_slice({ordered}, a, b)"
    score = f"CAST(len(list_intersect({wanted}, {run})) AS DOUBLE) / len(list_distinct(list_concat({wanted}, {run})))"
    return f"list_max(flatten(list_transform(range(1, len({ordered}) + 1), lambda a: list_transform(range(a, len({ordered}) + 1), lambda b: {score}))))"


def keyed(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))
