"""Streams of events and documents: windowed counts, deduplication, merges into tables, and the last row of a kind before each.

Every stream has a watermark, so that its state is bounded by the time that late rows are waited for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators import store


def _timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """The rows with a watermark on their time, which may come without a zone."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def activity(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(kind, begin, n, latest) by windows of the rows' own time; rows that are more than ``late`` behind are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    sums = _timed(events, time, late).groupBy(kind, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("latest"))
    return sums.select(kind, F.col("w.start").alias("begin"), "n", "latest")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, begin, end, n) of the runs of a key's rows that are less than ``gap`` apart."""
    sums = _timed(events, time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return sums.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def first_seen(rows: DataFrame, identity: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """The rows whose identity was not seen within the watermark."""
    return _timed(rows, time, late).dropDuplicatesWithinWatermark(identity)


def merged_into(rows: DataFrame, path: str, key: str, checkpoint: str, sources: str = "sources") -> StreamingQuery:
    """Merge each batch of rows into the table at a path by key; a batch that is repeated after a failure changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert_table(batch.sparkSession, path, batch, key, sources)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_of_kind(events: DataFrame, kind: str, key: str = "user_id", order: str = "event_id", label: str = "event_type") -> DataFrame:
    """(key, order, last): of every row, the last row of a kind before or at it among its key's; the state is one number a key.

    Rows of a batch are put in order within each key; a row that comes in a later batch than its followers does not change them.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for place, name in zip(rows[order].tolist(), rows[label].tolist(), strict=True):
            last = place if name == kind else last
            out.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: keys[0], order: rows[order].to_numpy(), "last": pd.array(out, dtype="Int64")})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, last long", "last long", "append", GroupStateTimeout.NoTimeout)
