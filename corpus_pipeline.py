"""A corpus pipeline of five stages: language, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.

Defined results: null texts and texts without a letter go in the first stage; of fully repeated rows one stays after the second,
and a row without an id goes there if a copy has one; rows without an id are never near copies; rows with equal ids and
different texts are told apart by their texts; very long texts are read whole; an empty table gives an empty one; extra columns
are carried to the last stage, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import stored
from textloom.llm.exact import drop_exact_duplicates
from textloom.llm.langid import keep_identified
from textloom.llm.packing import pack
from textloom.llm.pii import sanitised
from textloom.llm.probminhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("personal", personal), ("packing", packing)]

#: Learned and hashed stages have no SQL; tests/llm hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
