"""Exact byte-level BPE ids with the tokenizers library, memoised by chunk.

A pre-token of this tokenizer never runs on from a non-space character into white space, nor from a letter or digit
into punctuation, and the only lookahead of its pattern, at the end of white space, sees the same there in a chunk as
in the text. So a text may be cut at such places, and its ids are those of its chunks, one after the other. Common
cuts (before a space, a newline, a full stop or a comma) take plain string replacement; a text in which one of those
would be no such place is cut by the pattern SAFE instead. Special tokens are one id each, as the library gives by default;
what stands between them is encoded as texts of its own.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

#: Cuts that always hold: white space, then what follows up to the next white space.
SAFE = re.compile(r"\s*\S+|\s+\Z")
#: Where a cut before a space, newline, full stop or comma might not hold.
UNSAFE = re.compile(r"[.,\n \0](?:(?<=[\W_][.,])|(?<=\s[ \n])(?=\s|\Z)|(?<=\0))")
#: One pre-token for certain, of which the model alone gives the ids.
ONE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,\n]")
#: Chunks longer than this are encoded each time and not remembered.
LONGEST = 40
#: Entries of each of the two generations that a worker remembers.
REMEMBERED = 500_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.letters = _byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> bytes:
        if ONE.fullmatch(chunk):
            ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str, end: int | None = None) -> bytes:
        if any(s in text for s in self.special):
            out = b"".join(self.special[x] if k % 2 else self._plain(x) for k, x in enumerate(self.split.split(text)))
        else:
            out = self._plain(text)
        return out if end is None else out + int(end).to_bytes(4, "little")

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if UNSAFE.search(text):
            chunks = SAFE.findall(text)
        else:
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,").split("\0")
        new = self.new
        try:
            out = b"".join(map(new.__getitem__, chunks))
        except KeyError:
            if len(new) > REMEMBERED:
                self.old, self.new = new, {}
                new = self.new
            old, parts = self.old, []
            for c in chunks:
                b = new.get(c)
                if b is None:
                    b = old.get(c)
                    if b is None:
                        b = self._ids(c) if c else b""
                    if len(c) <= LONGEST:
                        new[c] = b
                parts.append(b)
            out = b"".join(parts)
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Give back the memory of this process's encoders: workers are reused, and a later operator may need it."""
    _encoders.clear()


def crc(b: bytes) -> int:
    return zlib.crc32(b) & 0xFFFFFFFF
