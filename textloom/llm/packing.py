"""Packing token sequences into fixed windows by non-negative least squares over the length histogram.

A document of n ids fills n // window windows alone; its tail, shorter than the window, is packed with other tails.
The driver sees only the histogram of tail lengths (window - 1 counts, whatever the corpus): it enumerates the
combinations of up to ``depth`` lengths that fill a window exactly, solves for their repeat counts by non-negative least
squares, rounds, and packs what is left greedily, best fit first. The plan is a bounded table of slots
(length, rank range, first sequence, offset); a tail takes the slot of its rank among the tails of its length.

Defined results: a null text counts as empty and packs as its end id alone; rows with equal doc_id are separate
documents; null ids are kept; an empty table gives no pieces; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored
from textloom.llm.tok import crc, encoder

WINDOW = 1024
DEPTH = 3
#: What rounding leaves is solved for again, so many times in all.
PASSES = 2
#: Rows of a block in which ranks are counted; blocks grow in number, not in size.
BLOCK_ROWS = 20_000


def combinations(window: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of 2 to ``depth`` (at most 3) lengths whose sum is the window, largest first, padded with 0."""
    pairs = np.array([(window - b, b, 0) for b in range(1, window // 2 + 1)], dtype=np.int64).reshape(-1, 3)
    if depth < 3:
        return pairs
    triples = [(window - b - c, b, c) for c in range(1, window // 3 + 1) for b in range(c, (window - c) // 2 + 1)]
    return np.concatenate([pairs, np.array(triples, dtype=np.int64).reshape(-1, 3)])


def solve_repeats(combos: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that about minimises |A x - hist|, where column j of A counts the lengths of combination j.

    Accelerated projected gradients; A is sparse (three entries a column), so a round is two gathers.
    """
    used = combos > 0
    live = np.all((hist[combos] > 0) | ~used, axis=1)
    x = np.zeros(len(combos))
    if not live.any():
        return x
    c, u = combos[live], used[live]

    def times(v: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c[u[:, k], k], v[u[:, k]], minlength=len(hist)) for k in range(c.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[c] * u).sum(axis=1)

    v = np.ones(len(c))
    for _ in range(20):  # the largest eigenvalue of A'A, for the step
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / np.linalg.norm(back(times(v))) / 1.05
    y = z = np.zeros(len(c))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(times(z) - hist))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, y, t = new + (t - 1) / t_new * (new - y), new, t_new
    x[live] = y
    return x


def round_repeats(combos: np.ndarray, x: np.ndarray, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts and what they leave of hist. The fraction of a count is carried on to the next combination."""
    left, out, carry = hist.tolist(), np.zeros(len(combos), np.int64), 0.0
    some = np.flatnonzero(x > 1e-9)
    for j, (a, b, c), share in zip(some.tolist(), combos[some].tolist(), x[some].tolist(), strict=True):
        want = share + carry
        n = int(want)
        if n:
            times = {a: 1}
            times[b] = times.get(b, 0) + 1
            if c:
                times[c] = times.get(c, 0) + 1
            n = min(n, min(left[k] // t for k, t in times.items()))
            for k, t in times.items():
                left[k] -= n * t
            out[j] = n
        carry = min(want - n, 1.0)
    left = np.array(left, dtype=np.int64)
    return out, left


def pack_rest(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Combinations and repeat counts for the lengths left over.

    The longest length that is left opens a window, and the longest that still fits follows, as often as one does; the
    window is repeated while its lengths last, so that each step uses up a length.
    """
    left, out = left.tolist(), []
    longest = window - 1
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        lengths, times, space, k = [], {}, window, longest
        while k and space:
            k = min(k, space)
            while k and left[k] <= times.get(k, 0):
                k -= 1
            if k:
                lengths.append(k)
                times[k] = times.get(k, 0) + 1
                space -= k
        n = min(left[k] // t for k, t in times.items())
        for k, t in times.items():
            left[k] -= n * t
        out.append((lengths, n))


def _planned(hist: np.ndarray, window: int, depth: int) -> list[tuple[list[int], int]]:
    """Combinations of up to ``depth`` lengths with their repeat counts, then those of the rest."""
    combos, left = combinations(window, depth), hist
    repeats = np.zeros(len(combos), np.int64)
    for _ in range(PASSES):
        more, left = round_repeats(combos, solve_repeats(combos, left.astype(float)), left)
        repeats += more
        if not more.any():
            break
    return [(combos[j][combos[j] > 0].tolist(), int(repeats[j])) for j in np.flatnonzero(repeats)] + pack_rest(left, window)


def slots(hist: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset), by length and rank; sequences count from 0.

    Combinations of two lengths alone are tried as well as deeper ones, and the plan of fewer sequences holds.
    """
    tried = [_planned(hist, window, d) for d in range(2, depth + 1)]
    whole = min(tried, key=lambda plan: sum(n for _, n in plan))
    rank, rows, sequence = np.zeros(window, np.int64), [], 0
    for lengths, n in whole:
        offset = 0
        for length in lengths:
            rows.append((length, rank[length], rank[length] + n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    out = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def tokenised(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Of each document: ids in all, checksums of its full windows, length and checksum of its tail."""
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("full", pa.list_(pa.int64())), ("tail", pa.int32()), ("tail_crc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(tokenizer), 4 * window
        for b in batches:
            n, full, tail, tail_crc = [], [], [], []
            for text in b.column(1):
                ids = enc.encode(text.as_py() or "", end_id)
                whole = len(ids) // size
                n.append(len(ids) // 4)
                full.append([crc(ids[i * size : (i + 1) * size]) for i in range(whole)])
                tail.append(len(ids) // 4 - whole * window)
                tail_crc.append(crc(ids[whole * size :]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([b.column(0).to_pylist(), n, full, tail, tail_crc], schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, full array<long>, tail int, tail_crc long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, depth: int = DEPTH, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents (doc_id, text).

    Sequences 0 up hold the packed tails, the next ones a full window each. Ranks are counted by blocks of a hash of
    the document, so that a frequent length is no hot key.
    """
    spark = docs.sparkSession
    rows = stored(tokenised(docs, tokenizer, window, end_id), "packing")
    n_rows = rows.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "doc_tokens", "tail_crc"), F.lit(blocks)).cast("int"))
    hist = np.zeros(window, np.int64)
    for r in rows.filter("tail > 0").groupBy("tail").count().collect():  # window - 1 rows at most
        hist[r["tail"]] = r["count"]
    plan = slots(hist, window, depth)
    n_packed = int((plan[:, 3] + plan[:, 2] - plan[:, 1]).max()) if len(plan) else 0
    # Counts before a block: of tails by length, and of full windows.
    before = Window.partitionBy("tail").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tails_before = rows.groupBy("tail", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("rank_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    sums = rows.groupBy("block").agg(F.sum(F.size("full")).alias("n"))
    full_before = sums.withColumn("full_before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = [F.col("doc_id"), F.col("doc_tokens"), F.col("tail_crc")]
    in_tail = Window.partitionBy("block", "tail").orderBy(*order)
    in_block = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.repartition(blocks, "block").withColumn("full_rank", F.coalesce(F.sum(F.size("full")).over(in_block), F.lit(0))).withColumn("tail_rank", F.row_number().over(in_tail) - 1)
    ranked = ranked.join(full_before, "block").join(tails_before, ["block", "tail"])
    ranked = ranked.select("doc_id", "doc_tokens", "full", "tail", "tail_crc", (F.col("rank_before") + F.col("tail_rank")).alias("rank"), (F.col("full_before") + F.col("full_rank") + n_packed).alias("first_full"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    shared = spark.sparkContext.broadcast((plan, np.searchsorted(plan[:, 0], np.arange(window + 1))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = shared.value
        for b in batches:
            doc, n, full, tail, tail_crc, rank, first = (b.column(i) for i in range(7))
            n, tail, rank, first, tail_crc = (x.to_numpy(zero_copy_only=False) for x in (n, tail, rank, first, tail_crc))
            counts = full.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(n)), counts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            some = np.flatnonzero(tail > 0)
            # Slots are sorted by length, then rank: the last that begins at or before the rank.
            key = table[:, 0] * (1 << 44) + table[:, 1]
            slot = np.searchsorted(key, tail[some].astype(np.int64) * (1 << 44) + rank[some], side="right") - 1
            take = pa.array(np.concatenate([of, some]))
            cols = [
                doc.take(take),
                pa.array(np.concatenate([nth * window, n[some] - tail[some]])),
                pa.array(np.concatenate([np.full(len(of), window), tail[some]]).astype(np.int64)),
                pa.array(np.concatenate([full.flatten().to_numpy(zero_copy_only=False), tail_crc[some]])),
                pa.array(n[np.concatenate([of, some])]),
                pa.array(np.concatenate([first[of] + nth, table[slot, 3] + rank[some] - table[slot, 1]])),
                pa.array(np.concatenate([np.zeros(len(of), np.int64), table[slot, 4]])),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in cols], names=names)

    return ranked.mapInArrow(place, ", ".join(f"{c} long" for c in names))


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into sequences of 1024 ids."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
