"""Token ids in Parquet list columns.

Ids are written in ascending document order to files of a list column of unsigned 16 or 32-bit ids, dictionary or delta
encoded, in row groups of a bounded number of ids, in pages of PAGE_ROWS documents at most, with page indexes. Whole
files are read group by group; a range of documents is read through Spark's reader, which skips files by the manifest, row
groups by their statistics and pages by the page indexes. Either way only the columns asked for are read. Columns: doc_id,
start (the document's first id within the file), n_tokens, ids.

Defined results: a null text counts as empty (its only id is the end id); null ids of documents come first, and no range
holds them; rows with the same doc_id are ordered by their texts; an empty table makes no file and reads as an empty table;
extra columns are left out. The rows of one doc_id are written by one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import scratch, stored
from textloom.llm.tok import crc, encoder
from textloom.llm.warc import open_fs

#: Ids of a row group and bytes of a data page, at most one document more.
GROUP_IDS = 1 << 20
PAGE_BYTES = 1 << 18
#: Documents of a page at most.
PAGE_ROWS = 128
FILES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.uint16()))])
MANIFEST = "part long, path string, rows long, tokens long, first_id long, last_id long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, encoding: str = "dictionary", parts: int | None = None) -> DataFrame:
    """Encode documents (doc_id, text) and write them in ascending doc_id order; returns the manifest of the files.

    Documents are dealt out by ranges of doc_id and sorted within; part numbers follow the order of the ranges.
    ``encoding``: "dictionary" or "delta" (DELTA_BINARY_PACKED).
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    wide = pa.schema([*list(FILES)[:3], pa.field("ids", pa.list_(pa.uint32()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        small = enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        schema, kind = (FILES, np.uint16) if small else (wide, np.uint32)
        out = path = part = None
        total = n_rows = held = 0
        first = last = None
        ids, starts, counts, docs_ = [], [], [], []

        def flush() -> None:
            nonlocal ids, starts, counts, docs_, held
            flat = np.concatenate(ids)
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))
            out.write_table(pa.Table.from_arrays([pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), lists], schema=schema), row_group_size=max(1, len(counts)))
            ids, starts, counts, docs_, held = [], [], [], [], 0

        try:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if out is None:
                        part = b.column(2)[0].as_py()
                        store, top = open_fs(folder)
                        store.create_dir(top, recursive=True)
                        path = f"part-{part:05d}-{uuid.uuid4().hex}.parquet"
                        how = {"use_dictionary": ["ids.list.element"]} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED"}}
                        out = pq.ParquetWriter(f"{top}/{path}", schema, filesystem=store, compression="zstd", compression_level=1, write_page_index=True, data_page_size=PAGE_BYTES, max_rows_per_page=PAGE_ROWS, dictionary_pagesize_limit=1 << 20, **how)
                    one = np.frombuffer(enc.encode(text or "", end_id), "<u4")
                    ids.append(one)
                    starts.append(total)
                    counts.append(len(one))
                    docs_.append(doc_id)
                    first, last = doc_id if first is None else first, doc_id
                    total, n_rows, held = total + len(one), n_rows + 1, held + len(one)
                    if held >= GROUP_IDS:
                        flush()
            if counts:
                flush()
        finally:
            if out is not None:
                out.close()
        if out is not None:
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
            row = [part, f"{folder}/{path}", n_rows, total, first, last]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split(" ")[0] for x in MANIFEST.split(", ")])

    return stored(rows.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids of all files before each; it has one row for each file."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("file_start", F.coalesce(F.sum("tokens").over(w), F.lit(0)))


def _crc32s(rows: DataFrame, columns: tuple[str, ...], kinds: dict[str, str]) -> DataFrame:
    """The rows with ids_crc32 worked out from their ids."""
    if "ids_crc32" not in columns:
        return rows.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = pa.array([crc(np.array(v, "<u4").tobytes()) for v in b.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([sums if c == "ids_crc32" else b.column(c) for c in columns], names=list(columns))

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


KINDS = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "array<int>", "ids_crc32": "long"}


def read_range(manifest: DataFrame, first: int, last: int, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The documents whose doc_id is from first to last, read by file, row group, page and column."""
    spark = manifest.sparkSession
    files = with_starts(manifest).filter((F.col("first_id") <= last) & (F.col("last_id") >= first))
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "file_start")
    paths = [r.path for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{c} {KINDS[c]}" for c in columns))
    rows = spark.read.parquet(*paths).filter(F.col("doc_id").between(first, last))
    need = ["ids" if c == "ids_crc32" else c for c in columns if c not in ("doc_id", "start")]
    rows = rows.select("doc_id", "start", F.col("_metadata.file_name").alias("file"), *dict.fromkeys(need))
    rows = rows.join(F.broadcast(files.drop("path")), "file").withColumn("start", F.col("start") + F.col("file_start"))
    if "ids" in need:
        rows = rows.withColumn("ids", F.col("ids").cast("array<int>"))
    return _crc32s(rows, columns, KINDS)


def read_tokens(manifest: DataFrame, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids"), doc_ids: tuple[int, int] | None = None, tasks: int | None = None) -> DataFrame:
    """Documents of the files, or of a range of doc_ids (first, last; see read_range).

    ``start`` counts ids of all documents before. Columns not asked for are not read; ids_crc32 may be asked for.
    """
    if doc_ids:
        return read_range(manifest, *doc_ids, columns)
    spark = manifest.sparkSession
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    arrow = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_crc32": pa.int64()}
    schema = pa.schema([(c, arrow[c]) for c in columns])
    need = sorted({"ids" if c == "ids_crc32" else c for c in columns})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = open_fs(path)
                with store.open_input_file(at) as f:
                    file = pq.ParquetFile(f)
                    for g in range(file.num_row_groups):
                        t = file.read_row_group(g, columns=need)
                        out = {}
                        for c in columns:
                            if c == "start":
                                out[c] = pa.array(t["start"].to_numpy() + base)
                            elif c == "ids_crc32":
                                lists = t["ids"].combine_chunks()
                                flat = lists.values.to_numpy().astype("<u4")
                                cut = lists.offsets.to_numpy()
                                out[c] = pa.array([crc(flat[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.int64())
                            else:
                                out[c] = t[c].combine_chunks().cast(arrow[c])
                        yield from pa.table(out, schema=schema).to_batches()

    files = with_starts(manifest).select("path", "file_start").repartition(tasks)
    return files.mapInArrow(read, ", ".join(f"{c} {KINDS[c]}" for c in columns))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded, written in id order and read back from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest, ("doc_id", "start", "n_tokens", "ids_crc32"))
