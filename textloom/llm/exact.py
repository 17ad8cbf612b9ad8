"""Exact deduplication with a heavy-hitter split.

A mergeable Misra-Gries summary (Spark's approx_top_k) names the digests that may be frequent; their exact counts and
winners are summed with map-side aggregation and broadcast, and their rows never enter the shuffle. The rows of
all other digests, each at most a TRACKED-th part of the table, are grouped by an ordinary shuffle.

Texts are equal if they are identical after deleting every character of [\\x20\\x09-\\x0D]; a null text counts as empty.
The row with the most code points in the original text stays, then that with the least doc_id (null ids last), then that
with the least hash of the original text, then one of the equal rows. Every row of the table has a row in the result, also
rows with equal ids; an empty table gives an empty one; extra columns are left out. Only DataFrame operations are used.

drop_exact_duplicates tells rows by their id and original text. Of fully repeated such rows, which may differ in other
columns, one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import salted_groups, stored

#: Digests that the summary tracks, and so the rows of its broadcast at most.
TRACKED = 1024
#: Ranges into which a digest's rows are dealt out where they are grouped by an ordinary shuffle.
SALTS = 16
#: Rows that do not stay, up to which they are broadcast (24 bytes each).
BROADCAST_GONE = 500_000


def normalised(text: Column) -> Column:
    """The text without its white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (binary SHA-256 of the normalised text), n (code points of the original), own (its hash) and row (a unique number)."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), _own(F.col("text")).alias("own"), F.monotonically_increasing_id().alias("row"))


def _own(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def frequent(rows: DataFrame, key: str, tracked: int = TRACKED) -> DataFrame:
    """The keys that the summary counted at least twice; those above a tracked-th part of the rows are surely among them."""
    items = rows.agg(F.expr(f"approx_top_k(hex({key}), {tracked}, {4 * tracked})").alias("top")).select(F.explode("top").alias("x"))
    return items.filter("x.count > 1").select(F.unhex("x.item").alias(key))


def exact_duplicates(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and own (a hash of the original text) of every document (doc_id, text)."""
    rows = stored(digests(docs), "digests")
    heavy = stored(frequent(rows, "digest", tracked), "frequent")
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "own", "row")
    winners = rows.join(F.broadcast(heavy), "digest").groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    winners = stored(winners, "winners")
    head = rows.join(F.broadcast(winners), "digest")
    # A window would gather a digest's rows in one task; the salted groups hand its winner back to its parts.
    tail = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    groups = salted_groups(tail.withColumn("order", order), "digest", F.col("row"), [F.min("order").alias("least"), F.count(F.lit(1)).alias("n_part")], [F.min("least").alias("first"), F.sum("n_part").alias("group_size")], SALTS)
    tail = tail.join(groups, ["digest", "salt"])
    names = ["doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "own"]
    return head.select(*names).unionByName(tail.select(*names))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("own")


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents
), r AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those of a group of equal texts that do not stay.

    Only (doc_id, own) of the rows that go are joined to the texts, broadcast if they are few enough; fully repeated rows are
    reduced to one if there are any.
    """
    found = stored(exact_duplicates(docs).select("doc_id", "own", "kept"), "verdicts")
    counts = found.groupBy("doc_id", "own").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    gone = stored(counts.filter(~F.col("any")).select(F.col("doc_id").alias("gone_id"), F.col("own").alias("gone_own")), "gone")
    small = F.broadcast if gone.count() <= BROADCAST_GONE else (lambda x: x)
    rows = docs.withColumn("own_", _own(F.col("text")))
    rows = rows.join(small(gone), (F.col("own_") == F.col("gone_own")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    if not counts.filter(F.col("any") & (F.col("n") > 1)).isEmpty():
        rows = rows.dropDuplicates(["doc_id", "own_"])
    return rows.select(*docs.columns)
