"""SentencePiece BPE encoding with a prefix table, and decoding.

For each prefix of a text the table stores the one token that its encoding ends with. The pieces that end at a
position come from an Aho-Corasick automaton; a piece follows the prefix before it if it is compatible with that
prefix's last token, that is, if the two together encode to just these two. Ids are then read backwards. Characters
outside the vocabulary are byte tokens and cut the text.

The table is built chunk by chunk: no piece has a space mark after another character, nor a character pair that no
piece has, so the text may be cut at such places; ids, counts and decoded bytes of short chunks are remembered.

Defined results: a null or empty text has no ids and decodes to the empty text; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = "▁"
LONGEST = 40
REMEMBERED = 400_000


class PieceCodec:
    """Encoder and decoder of a BPE model with byte fallback, identity normaliser and a space mark in front."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.special = special - self.byte_of.keys()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        chars = {c for p in self.id_of for c in p}
        self.known = {c for c in chars if c in self.id_of}
        if any(c not in self.id_of for c in chars):
            raise ValueError("a piece has a character that is no piece")
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece has a space mark after another character")
        pairs = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        #: Where a cut before a full stop or comma, or around a newline, might not hold.
        before = {c: "".join(sorted({x[0] for x in pairs if x[1] == c})) for c in ".,"}
        rules = [f"[{re.escape(c)}](?<=[{re.escape(before[c])}]{re.escape(c)})" for c in before if before[c]]
        self.unsafe = re.compile("|".join([*rules, f"{SPACE}{SPACE}", "\0"]))
        self.newline = "\n" not in chars
        self.pair_ok: dict[int, bool] = {}
        self.alone_ok: dict[int, bool] = {}
        self.new: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {"": ("", 0, b"")}

    def merged(self, text: str) -> list[str]:
        """The definition, for short texts: the best-scored adjacent pair is merged, the leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.score[p], -k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.score]
            if not found:
                break
            k = -max(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        ok = self.pair_ok.get(key)
        if ok is None:
            a, b = self.pieces[left], self.pieces[right]
            if len(self.pair_ok) > 4 * REMEMBERED:
                self.pair_ok.clear()
            ok = self.pair_ok[key] = self.merged(a + b) == [a, b]
        return ok

    def complete(self, token: int) -> bool:
        ok = self.alone_ok.get(token)
        if ok is None:
            ok = self.alone_ok[token] = len(self.merged(self.pieces[token])) == 1
        return ok

    def table(self, text: str) -> list[int]:
        """ids of a text of known characters."""
        last, length = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for end, (token, n) in self.automaton.iter(text):
            at = end + 1 - n
            if last[end + 1] < 0 and (self.complete(token) if at == 0 else last[at] >= 0 and self.compatible(last[at], token)):
                last[end + 1], length[end + 1] = token, n
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= length[end]
        return out[::-1]

    def _ids(self, chunk: str) -> list[int]:
        if all(c in self.known for c in chunk):
            return self.table(chunk) if chunk else []
        out, begin = [], 0
        for k, c in enumerate(chunk):
            if c not in self.known:
                if begin < k:
                    out += self.table(chunk[begin:k])
                out += [self.id_of_byte[b] for b in c.encode("utf-8", "surrogatepass")]
                begin = k + 1
        if begin < len(chunk):
            out += self.table(chunk[begin:])
        return out

    def chunks(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE)
        if self.unsafe.search(marked):
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)
        marked = marked.replace(SPACE, "\0" + SPACE).replace(".", "\0.").replace(",", "\0,")
        if self.newline:
            marked = marked.replace("\n", "\0\n\0")
        return marked.split("\0")

    def _learn(self, chunk: str) -> tuple[str, int, bytes]:
        known = self.old.get(chunk)
        if known is None:
            ids = self._ids(chunk)
            known = "".join(f"{i}," for i in ids), len(ids), self.to_bytes(ids)
        if len(chunk) <= LONGEST:
            if len(self.new) > REMEMBERED:
                self.old, self.new = self.new, {"": ("", 0, b"")}
            self.new[chunk] = known
        return known

    def encoded(self, text: str) -> list[tuple[str, int, bytes]]:
        """Of each chunk: its decimal ids, each with a comma after it, their count and their decoded bytes."""
        if not text:
            return []
        new, out = self.new, []
        for c in self.chunks(text):
            x = new.get(c)
            if x is None:
                x = self._learn(c)
                new = self.new
            out.append(x)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for c in (self.chunks(text) if text else []) for i in self._ids(c)]

    def to_bytes(self, ids: list[int]) -> bytes:
        """Decoded bytes, the space mark in front included."""
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else self.pieces[i].replace(SPACE, " ").encode() for i in ids)

    @staticmethod
    def to_text(data: bytes) -> str:
        """Decoded bytes as text: without the first space; what is no UTF-8 is replaced byte by byte."""
        out = data.decode("utf-8", "replace")
        return out.removeprefix(" ")

    def decode(self, ids: list[int]) -> str:
        return self.to_text(self.to_bytes(ids))


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of this worker process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of every document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids = [np.fromstring("".join([x[0] for x in c.encoded(t.as_py() or "")]), np.int32, sep=",") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, then decoded chunk by chunk."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column(1):
                parts = c.encoded(t.as_py() or "")
                n.append(sum([x[1] for x in parts]))
                ids.append(hashlib.sha256("".join([x[0] for x in parts])[:-1].encode()).hexdigest())
                decoded.append(hashlib.sha256(c.to_text(b"".join([x[2] for x in parts])).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded to pieces and decoded."""
    import public_tokenizers

    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
