"""Quality rules with adaptive thresholds.

Fixed base rules come first (too few words, too much repetition). The rest compares each document with its own cell, the
documents of its language and source: mergeable KLL quantile sketches of each measure are summed by cell, and a
document fails if a measure lies beyond the cell's quartiles by more than FENCE times their distance (at least the
measure's least spread, so that a uniform cell rejects no ordinary document).

Words are runs of [^\\x20\\x09-\\x0D]. Defined results: null and wordless texts have no words and fail the base rules;
null languages and sources are cells of their own; rows with equal ids are judged one by one; an empty table gives an
empty one; extra columns are left out. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WORD_CLASS, WS_CLASS, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 6.0
SKETCH_K = 400
#: Measures and their least spread.
MEASURES = {"symbol_share": 0.03, "repeat_share": 0.05, "duplicate_line_share": 0.05, "word_length": 0.5}
#: Cells up to this many are broadcast.
BROADCAST_CELLS = 20_000
#: Parts of a cell that is not broadcast.
SALTS = 16
_BITS = 24


def repeat_words(windows: Column, sorted_windows: Column) -> Column:
    """Words in 3-word windows found twice or more; windows are hashes by place, sorted_windows the same with places, sorted."""
    at = lambda k: F.get(sorted_windows, k)
    twice = F.filter(
        F.transform(sorted_windows, lambda x, k: F.when((x.h == at(k - 1).h) | (x.h == at(k + 1).h), x.i)),
        lambda i: i.isNotNull(),
    )
    return _covered(twice)


def _covered(places: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))).cast("long")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """Base columns and measures of every document (doc_id, text, lang, source)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", *keep, text.alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", WS_CLASS + "+"), lambda x: x != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CLASS))
    rows = rows.withColumn("lines", lines).withColumn("n_words", F.size("w").cast("long"))
    triple = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("h", F.when(F.size("w") >= 3, triple).otherwise(none))
    # Places in the low bits of the hashes: longs sort fastest. Hashes that only share their high bits are told apart
    # by sorting the whole hashes of such a text.
    packed = F.transform("h", lambda x, i: F.shiftleft(F.shiftright(x, _BITS), _BITS).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("s", F.sort_array(packed))
    high = lambda k: F.shiftright(F.get("s", k), _BITS)
    place = lambda k: F.get("s", k).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    full = lambda k: F.get("h", place(k))
    steps = F.when(F.size("s") > 1, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    found = F.filter(F.transform(steps, lambda k: F.when((high(k) == high(k - 1)) | (high(k) == high(k + 1)), place(k))), lambda i: i.isNotNull())
    clash = F.exists(steps, lambda k: (high(k) == high(k - 1)) & (full(k) != full(k - 1)))
    slow = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("twice", found).withColumn("clash", clash | (F.size("h") >= (1 << _BITS)))
    rows = rows.withColumn("exact", F.when(F.col("clash"), slow))
    repeated = F.when(F.col("clash"), repeat_words(F.col("h"), F.col("exact"))).otherwise(_covered(F.col("twice")))
    out = rows.select(
        "doc_id", "lang", "source", *keep, "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        repeated.alias("n_repeat_words"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return (
        out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("symbol_share", share("n_symbols", "word_chars"))
        .withColumn("repeat_share", share("n_repeat_words", "n_words"))
        .withColumn("duplicate_line_share", share("n_dup_lines", "n_lines"))
        .withColumn("word_length", share("word_chars", "n_words"))
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """Least and largest value of each measure by lang and source, from sketches over all their documents with words."""
    sketches = rows.groupBy("lang", "source").agg(*[F.expr(f"kll_sketch_agg_double({m}, {SKETCH_K})").alias(m) for m in MEASURES], F.count("word_length").alias("n"))
    q = lambda m, p: F.expr(f"kll_sketch_get_quantile_double({m}, {p}D)")
    cells = sketches.filter("n > 0").select("lang", "source", *[F.array(q(m, 0.25), q(m, 0.75)).alias(m) for m in MEASURES])
    for m, least in MEASURES.items():
        spread = F.greatest(F.get(m, 1) - F.get(m, 0), F.lit(least)) * FENCE
        cells = cells.withColumn(f"{m}_min", F.get(m, 0) - spread).withColumn(f"{m}_max", F.get(m, 1) + spread).drop(m)
    return cells


def judged(rows: DataFrame) -> DataFrame:
    """The measured rows with the verdict of their cell's thresholds.

    Rows are read twice, first for the sketches; nothing but the thresholds is written in between. More cells than can be
    broadcast are dealt out SALTS times, so that a hot cell's rows go to as many tasks.
    """
    cells = stored(thresholds(rows), "thresholds")
    cells = cells.withColumnRenamed("lang", "cell_lang").withColumnRenamed("source", "cell_source")
    on = F.col("lang").eqNullSafe(F.col("cell_lang")) & F.col("source").eqNullSafe(F.col("cell_source"))
    if cells.count() <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(cells), on, "left")
    else:
        cells = cells.withColumn("cell_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt_", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(cells, on & (F.col("salt_") == F.col("cell_salt")), "left").drop("salt_", "cell_salt")
    inside = F.lit(True)
    for m in MEASURES:
        low = F.col(m) >= F.col(f"{m}_min") if m == "word_length" else F.lit(True)
        inside = inside & F.coalesce((F.col(m) <= F.col(f"{m}_max")) & low, F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    rows = measures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
