"""WARC archives: write pages as records, and read archives sequentially with framing and digest checks.

Format: one gzip member for each record; the reader inflates a member piece by piece, frames its block by
Content-Length and compares the block's and payload's digests with the header. Archives of other writers are read too:
records of any type (warcinfo, request, metadata, resource, conversion), fields in any case, with or without a space
after the colon, and folded over lines; digests may be absent, in hexadecimal or base32, by sha256, sha1, sha512 or
md5; those of other algorithms are not compared.

Defined results: a null payload is written as an empty one; null ids and URLs are written as absent and come back
null; an empty table makes no archive and reads as an empty table; rows with the same id and payload each get a record;
a group without any non-null id has no revisits; extra columns are left out.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import salted_groups, scratch, stored

#: Payloads below this many bytes are never written as revisits.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ_BYTES = 1 << 18
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_id string, content_type string"
ALGORITHMS = ("sha256", "sha1", "sha512", "md5")


class WarcError(ValueError):
    """An archive that breaks the format, or a block or payload that differs from its digest."""


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Payload-Length", str(len(payload)))]
    fields += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response")]
    return _record(fields, block)


def read_members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of an open archive; memory holds one record and one piece of the file."""
    rest = stream.read(READ_BYTES)
    while rest:
        z, buf, need, header, start = zlib.decompressobj(31), bytearray(), -1, {}, 0
        while not z.eof:
            if not rest:
                raise WarcError("archive ends inside a record")
            buf += z.decompress(rest)
            rest = z.unused_data if z.eof else stream.read(READ_BYTES)
            if need < 0 and (at := buf.find(b"\r\n\r\n")) >= 0:
                lines = re.sub(rb"\r\n[ \t]+", b" ", bytes(buf[:at])).decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise WarcError(f"no record header: {lines[0][:40]!r}")
                header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                if not header.get("content-length", "").isdecimal():
                    raise WarcError("a record without Content-Length")
                start, need = at + 4, int(header["content-length"])
        if need < 0 or len(buf) != start + need + 4 or buf[-4:] != b"\r\n\r\n":
            raise WarcError("a record's length differs from its Content-Length")
        if not rest:
            rest = stream.read(READ_BYTES)
        yield header, bytes(memoryview(buf)[start : start + need])


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and re.fullmatch(r"<urn:page:-?[0-9]+>", urn) else None


def digest_of(given: str | None, data: bytes) -> tuple[str | None, bool]:
    """A digest field's value in bare hexadecimal, as far as it can be read, and whether it belongs to the data."""
    name, _, value = (given or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ALGORITHMS:
        return (given or None), True
    true = hashlib.new(name, data).hexdigest()
    value = value.strip()
    if len(value) != len(true):
        try:
            value = base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
        except binascii.Error:
            return value, False
    return value.lower(), value.lower() == true


def parsed(header: dict[str, str], block: bytes, with_payload: bool = True) -> tuple:
    """A row of RECORDS, after both digests were compared, where they are given.

    The payload of an HTTP message is its body, that of any other record its block. A revisit has no payload of its own: its
    digest is that of the page it revisits, its length the one that the writer noted, or null.
    """
    name, kind = header.get("warc-record-id"), header.get("warc-type", "").lower()
    if not digest_of(header.get("warc-block-digest"), block)[1]:
        raise WarcError(f"block digest of {name}")
    at = block.find(b"\r\n\r\n") if header.get("content-type", "").lower().startswith("application/http") else -1
    payload = block[at + 4 :] if at >= 0 else block
    digest, same = digest_of(header.get("warc-payload-digest"), payload)
    if kind == "revisit":
        noted = header.get("x-payload-length", "")
        length, payload = int(noted) if noted.isdecimal() else None, None
    else:
        length = len(payload)
        if not same:
            raise WarcError(f"payload digest of {name}")
    digest = digest if digest or payload is None else hashlib.sha256(payload).hexdigest()
    refers = header.get("warc-refers-to")
    return (_page(name), header.get("warc-target-uri"), kind, _page(refers), length, digest, payload if with_payload else None, name, refers, header.get("content-type"))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def mark_revisits(pages: DataFrame, salts: int = 64) -> DataFrame:
    """payload, payload_digest, record_type and refers_to of each page.

    Only digests, lengths and ids are grouped; a digest that many pages share is dealt out over ``salts`` parts.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    keys = rows.filter(F.length("payload") >= REVISIT_BYTES).select("payload_digest", "salt", "page_id")
    first = salted_groups(keys, "payload_digest", F.col("page_id"), [F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")], [F.min("low").alias("first_id"), F.sum("n").alias("n")], salts)
    first = first.filter("n > 1").select("payload_digest", "salt", "first_id")
    joined = rows.join(first, ["payload_digest", "salt"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as archives under folder, one a task; returns their manifest (path, records).

    A retried or speculative task writes to a new name, and only the names in the manifest, which Spark commits once
    for each task, count; what a lost attempt left behind is never read.
    """
    marked = mark_revisits(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_fs(folder)
        out, path, n = None, "", 0
        try:
            for b in batches:
                for page_id, url, payload, digest, kind, refers_to in zip(*(b.column(i) for i in range(6)), strict=True):
                    if out is None:
                        store.create_dir(top, recursive=True)
                        path = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{top}/{path}", compression=None)
                    out.write(warc_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), kind.as_py() == "revisit", date))
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [n]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    manifest = marked.mapInArrow(write, "path string, records long")
    return stored(manifest, "warc-manifest")


def read_warc(manifest: DataFrame, with_payload: bool = True, tasks: int | None = None) -> DataFrame:
    """Records (see RECORDS) of the archives whose paths the manifest holds; each archive is read by one task, in order."""
    spark = manifest.sparkSession
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = pa.schema([(n, arrow[t]) for n, t in (x.split(" ") for x in RECORDS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = open_fs(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for header, block in read_members(stream):
                        rows.append(parsed(header, block, with_payload))
                        held += len(block) if with_payload else 200
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return manifest.select("path").repartition(tasks).mapInArrow(read, RECORDS)


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages written to archives and read back: what the records say."""
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    return read_warc(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id IS DISTINCT FROM p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
