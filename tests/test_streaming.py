"""Streams read from files, batch by batch, against the same sums over the whole table."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.streaming import streams

DATA = Path("/root/testdata/sf0.001/events.parquet")


@pytest.fixture
def stream(spark, tmp_path):
    """The events in three files, in order of time, one a batch."""
    events = spark.read.parquet(str(DATA)).select("event_id", "ts", "user_id", "event_type").limit(300).orderBy("ts", "event_id")
    rows = events.collect()
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], events.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_windows_and_sessions(stream, tmp_path):
    events, live = stream
    late = "3650 days"
    found = {(r.event_type, r.begin): r.n for r in drained(streams.activity(live, late=late), "complete", tmp_path, "activity")}
    assert found == {(r.event_type, r.h): r["count"] for r in events.groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).count().collect()}
    runs = drained(streams.sessions(live, late=late), "complete", tmp_path, "sessions")
    assert sum(r.n for r in runs) == events.count() and all(r.begin < r.end for r in runs)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_first_seen(stream, tmp_path):
    events, live = stream
    seen = drained(streams.first_seen(live, ["user_id", "event_type"], late="3650 days"), "append", tmp_path, "seen")
    assert len(seen) == events.select("user_id", "event_type").distinct().count()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_merge_of_batches(spark, stream, tmp_path):
    events, live = stream
    rows = live.select("user_id", F.col("event_id").alias("latest"), F.array("event_type").alias("sources"))
    path = str(tmp_path / "table")
    streams.merged_into(rows, path, "user_id", str(tmp_path / "check")).awaitTermination(120)
    found = spark.read.parquet(path)
    assert found.count() == events.select("user_id").distinct().count()
    kinds = {r.user_id: sorted(r.k) for r in events.groupBy("user_id").agg(F.collect_set("event_type").alias("k")).collect()}
    assert {r.user_id: r.sources for r in found.collect()} == kinds


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_last_of_kind(stream, tmp_path):
    from pyspark.sql import Window

    events, live = stream
    found = {r.event_id: r.last for r in drained(streams.last_of_kind(live, "view"), "append", tmp_path, "last")}
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert found == {r.event_id: r.last for r in events.select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("last")).collect()}
