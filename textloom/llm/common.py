"""Helpers shared by the corpus operators: shared storage, salted joins, exact prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space by the corpus contracts: [\x20\x09-\x0D].
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without it gets one of its own (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_groups(rows: DataFrame, key: str, row_id: Column, aggs: list[Column], finals: list[Column], salts: int = 64) -> DataFrame:
    """Group values for every row of a table with hot keys: one row for each (key, salt) that occurs.

    Rows are first aggregated by (key, salt), then by key; the value of the key is handed back to each of its at
    most ``salts`` salted parts. Joining the rows to it on (key, salt) deals a hot key out to many tasks.
    ``rows`` must have the column ``salt``.
    """
    parts = rows.groupBy(key, "salt").agg(*aggs)
    whole = parts.groupBy(key).agg(F.collect_set("salt").alias("salts_"), *finals)
    return whole.withColumn("salt", F.explode("salts_")).drop("salts_")
