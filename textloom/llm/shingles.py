"""64-bit hashes of word shingles, for whole Arrow batches at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at once; a longer text goes alone.
CHUNK_BYTES = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACE = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts data[cuts[i]:cuts[i + 1]], and the first word of each text (with the end)."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    start = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    length = np.flatnonzero(word & ~after) + 1 - start
    order = np.argsort(-length, kind="stable")
    by_length = -length[order]
    h = length.astype(np.uint64) * _ODD
    k, live = 0, len(order)
    while live:
        at = order[:live]
        h[at] = h[at] * np.uint64(0x100000001B3) + _BYTE[data[start[at] + k]]
        k += 1
        live = int(np.searchsorted(by_length, -k, side="left"))
    return mix(h), np.searchsorted(start, cuts)


def shingle_sets(data: np.ndarray, cuts: np.ndarray, n: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the sorted distinct shingle hashes and how often each occurs; texts of 1 to n - 1 words have one."""
    words, first = word_hashes(data, cuts)
    many = max(0, len(words) - n + 1)
    sums = np.zeros(many, np.uint64)
    for k in range(n):
        sums += words[k : k + many] * _PLACE[k]
    sums = mix(sums)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= n:
            s = np.sort(sums[i : j - n + 1])
        elif j > i:
            s = mix((words[i:j] * _PLACE[: j - i]).sum(dtype=np.uint64, keepdims=True) + np.uint64(j - i))
        else:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)
            continue
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        yield s[new], np.diff(np.append(new, len(s)))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to) of a string column with their bytes and cuts, of about CHUNK_BYTES each; null is empty."""
    if pa.types.is_large_string(column.type):
        offset_type = np.int64
    else:
        column, offset_type = column.cast(pa.string()), np.int32
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return
    cuts = np.frombuffer(offsets, offset_type)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j, data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]
        i = j
