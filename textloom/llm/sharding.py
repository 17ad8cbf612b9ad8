"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows are dealt into BLOCKS blocks by a hash; the block counts and the shard sizes (all rows over the shards, counts at
most one apart) are the margins of a matrix whose entries, how many rows of a block go to a shard, are drawn from the
multivariate hypergeometric distribution. Each block is permuted, its runs go to the shards by the matrix, and within each
shard the rows are permuted again. Orders are those of seeded hashes, so a lost task computes the same again. No key
decides where a row goes, so copies and frequent sources spread evenly.

Places within a block and slots within a shard are ranks by hash: blocks and shards are split into ranges of that hash,
whose counts are summed first, so that no task sorts a whole one. Only DataFrame operations are used; the driver draws the
matrix, of BLOCKS rows whatever the table's size, from the block counts.

Defined results: a null text has no bytes and the CRC of the empty text; rows with equal ids and texts are
interchangeable; null ids are sharded like any other; an empty table gives an empty one; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored

SHARDS = 40
#: Blocks of the exchange, and rows of a range within a block or shard, about.
BLOCKS = 256
RANGE_ROWS = 50_000
#: Counts that numpy's generator takes, and the standard deviations to either side that larger draws cover.
MOST = 10**9 - 1
REACH = 13


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def drawn(rng: np.random.Generator, good: int, bad: int, need: int, most: int = MOST) -> int:
    """A hypergeometric count: how many of ``need`` drawn without replacement are good.

    Counts above ``most``, which numpy's generator does not take, are drawn by inversion: the probabilities around the mode
    follow from their ratios, and what lies beyond REACH standard deviations is less than a double can tell from 0.
    """
    total = good + bad
    low, high = max(0, need - bad), min(need, good)
    if low == high:
        return low
    if max(good, bad) <= most:
        return int(rng.hypergeometric(good, bad, need))
    mode = min(high, max(low, (need + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(REACH * (need * share * (1 - share) * (total - need) / max(1, total - 1)) ** 0.5) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) - np.log(k + 1) + np.log(need - k) - np.log(bad - need + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + min(high - low, int(np.searchsorted(upto, rng.random() * upto[-1], side="right")))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Row counts from each block to each shard; both margins hold exactly.

    A block's row is a draw without replacement from the room that the shards have left, one hypergeometric count after
    the other.
    """
    rng, left = np.random.default_rng(seed), np.array(shards, dtype=np.int64)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for i, n in enumerate(blocks):
        need, room = n, int(left.sum())
        for j in range(len(shards)):
            good, bad = int(left[j]), room - int(left[j])
            if not need:
                break
            take = drawn(rng, good, bad, need)
            out[i, j] = take
            need -= take
            room -= good
            left[j] -= take
    return out


def _order(seed: int, *salt: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.lit(s) for s in salt], "doc_id", "text_crc32", "size")


def _ranked(rows: DataFrame, group: str, key: str, ranges: int, name: str) -> DataFrame:
    """The rows with their place from 0 in their group, in the order of a hash; groups are split into ranges of the hash."""
    top = F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) * F.lit(ranges) / F.lit(float(1 << 32))).cast("int")
    rows = rows.withColumn("range_", top)
    before = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(group, "range_").agg(F.count(F.lit(1)).alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    within = Window.partitionBy(group, "range_").orderBy(key, "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank_", F.row_number().over(within) - 1).join(starts, [group, "range_"])
    return ranked.withColumn(name, F.col("before_") + F.col("rank_")).drop("range_", "rank_", "before_")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document (doc_id, text)."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    # Rows with equal ids, texts and sizes meet in one block, whose order they share.
    slim = slim.withColumn("block", F.pmod(_order(seed, "block"), F.lit(blocks)).cast("int")).withColumn("local", _order(seed, "local"))
    slim = stored(slim, "sizes")
    counts = {r["block"]: r["count"] for r in slim.groupBy("block").count().collect()}
    total = sum(counts.values())
    matrix = communication_matrix([counts.get(i, 0) for i in range(blocks)], shard_sizes(total, shards), seed)
    ends = spark.createDataFrame([(i, row) for i, row in enumerate(np.cumsum(matrix, axis=1).tolist())], "block int, ends array<long>")
    rows = _ranked(slim, "block", "local", max(1, -(-total // (blocks * RANGE_ROWS))), "at").join(F.broadcast(ends), "block")
    rows = rows.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    final = F.xxhash64(F.lit(seed), F.lit("final"), "doc_id", "text_crc32", "size", "block", "at")
    rows = stored(rows.select("doc_id", "size", "text_crc32", "shard", final.alias("final")), "sharded")
    out = _ranked(rows, "shard", "final", max(1, -(-total // (shards * RANGE_ROWS))), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, by the law that counts are at most one apart."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
