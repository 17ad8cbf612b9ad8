"""Passage alignment: where a quoted source stands in a target text, whatever the spelling, with offsets.

A source is sought in the normalised target: verbatim, then as parts in order if it has an ellipsis, then as the window
of its own length whose set of character trigrams is most similar. Offsets count code points of the target in NFC.
Null texts count as empty; an empty source matches nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "window-3"
#: The similarity a window must have, by kind of block, and for other kinds.
THRESHOLDS = {"prakrit_gatha": 0.90, "sanskrit_gatha": 0.90, "hindi_gatha": 0.85, "prakrit_text": 0.80, "sanskrit_text": 0.80, "hindi_text": 0.80}
OTHERWISE = 0.80
GRAM = 3
#: Sources whose trigrams are looked up in a target together.
BLOCK = 256

#: What normalising removes. White space, joiners, dandas, dashes, punctuation, quotes, avagraha, visarga,
#: candrabindu; digits go last.
REMOVED = "\\s\u200c\u200d\u0964\u0965|\\-\u2010-\u2015_~,.;:!?\"'()\\[\\]{}/\\\\*+=<>&%\u2018\u2019\u201c\u201d\u093d\u0903\u0901"
CONSONANT = "\u0915-\u0939\u0958-\u095f"
VIRAMA, ANUSVARA = "\u094d", "\u0902"
#: The nasal of each class of consonants; the other consonants take the dental one.
NASALS = {"\u0915-\u0919": "\u0919", "\u091a-\u091e": "\u091e", "\u091f-\u0923": "\u0923", "\u0924-\u0928\u092f-\u0939\u0958-\u095f": "\u0928", "\u092a-\u092e": "\u092e"}
_NASAL = [(re.compile(f"[{chars}]"), nasal) for chars, nasal in NASALS.items()]
_BEFORE = re.compile(f"{ANUSVARA}(?=[{REMOVED}]*([{CONSONANT}]?))")
_DOUBLED = re.compile(f"\u0930{VIRAMA}([{CONSONANT}])([\u200c\u200d]*{VIRAMA}[\u200c\u200d]*\\1)")
_GONE = re.compile(f"[{REMOVED}0-9\u0966-\u096f]+")
_ELLIPSIS = re.compile(r"\.{3,}")


class Traced(NamedTuple):
    """A rewritten text and the place in the original of each of its characters."""

    text: str
    place: list[int]

    def rewritten(self, pattern: re.Pattern, by: Callable[[re.Match], tuple[str, int]]) -> Traced:
        """Each match replaced; ``by`` gives the new text and how many of the match's first places it takes (0: all the first)."""
        out, place, at = [], [], 0
        for m in pattern.finditer(self.text):
            new, kept = by(m)
            out += [self.text[at : m.start()], new]
            place += self.place[at : m.start()]
            place += self.place[m.start() : m.start() + kept] if kept else [self.place[m.start()]] * len(new)
            at = m.end()
        return Traced("".join([*out, self.text[at:]]), place + self.place[at:]) if out else self


def _nasal(m: re.Match) -> tuple[str, int]:
    if not m[1]:
        return "\u092e" + VIRAMA, 0
    for of, nasal in _NASAL:
        if of.match(m[1]):
            return nasal + VIRAMA, 0
    return ANUSVARA, 0


def _thresholds(spark) -> dict[str, float]:
    """The thresholds by kind of block; a setting textloom.threshold.<kind> goes before the fixed value."""
    return {k: float(spark.conf.get(f"textloom.threshold.{k}", str(v))) for k, v in THRESHOLDS.items()}


def normalised(text: str | None) -> Traced:
    whole = unicodedata.normalize("NFC", text or "").replace("\u1ced", VIRAMA)
    t = Traced(whole, list(range(len(whole)))).rewritten(_BEFORE, _nasal)
    while _DOUBLED.search(t.text):
        t = t.rewritten(_DOUBLED, lambda m: (m[0][:3], 3))
    return t.rewritten(_GONE, lambda m: ("", 0))


def plain_form(text: str | None) -> str:
    """The text of ``normalised`` without its places."""
    t = _BEFORE.sub(lambda m: _nasal(m)[0], unicodedata.normalize("NFC", text or "").replace("\u1ced", VIRAMA))
    while _DOUBLED.search(t):
        t = _DOUBLED.sub(lambda m: m[0][:3], t)
    return _GONE.sub("", t)


def parts_of(source: str | None) -> list[str]:
    """Normal forms of what stands between the ellipses of a source."""
    return [p for p in (normalised(x).text for x in _ELLIPSIS.split(unicodedata.normalize("NFC", source or ""))) if p]


def part_threshold(threshold: float) -> float:
    return max(0.6, threshold - 0.15)


def grams(text: str) -> list[str]:
    """Trigrams in order; a shorter text is its own."""
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)] or [text]


def best_window(source: str, target: str, begin: int = 0, step: int = 1) -> tuple[float, int]:
    """The greatest similarity of a window from ``begin`` on, and its first place; windows are ``step`` apart.

    The window slides one character at a time and its set is kept by counts, so that a target costs time in its length alone.
    """
    size = len(source)
    if not size or len(target) - begin < size:
        return 0.0, -1
    wanted, of = set(grams(source)), grams(target[begin:]) if size >= GRAM else [target[i : i + size] for i in range(begin, len(target) - size + 1)]
    width = max(1, size - GRAM + 1)
    inside, common, best, where = Counter(), 0, 0.0, -1
    for k, gram in enumerate(of):
        inside[gram] += 1
        common += inside[gram] == 1 and gram in wanted
        start = k - width + 1
        if start < 0:
            continue
        if start % step == 0:
            score = common / (len(wanted) + len(inside) - common)
            if score > best:
                best, where = score, begin + start
        old = of[start]
        inside[old] -= 1
        if not inside[old]:
            del inside[old]
            common -= old in wanted
    return best, where


class Found(NamedTuple):
    method: str
    score: float
    char_start: int | None = None
    char_end: int | None = None


def locate(source: str | None, target: str | None, threshold: float = OTHERWISE) -> Found:
    own, t = normalised(source).text, normalised(target)

    def at(method: str, score: float, start: int, end: int) -> Found:
        return Found(method, score, t.place[start], t.place[end - 1] + 1)

    if not own or not t.text:
        return Found("none", 0.0)
    if (start := t.text.find(own)) >= 0:
        return at("exact_normalized", 1.0, start, start + len(own))
    parts = parts_of(source)
    if len(parts) > 1:
        spans, cursor = [], 0
        for part in parts:
            start = t.text.find(part, cursor)
            if start < 0:
                score, start = best_window(part, t.text, cursor)
                if score < part_threshold(threshold):
                    break
            if start < 0:
                break
            cursor = start + len(part)
            spans.append((start, cursor))
        if len(spans) == len(parts):
            return at("exact_normalized_ellipsis", 1.0, spans[0][0], spans[-1][1])
    score, start = best_window(own, t.text)
    if start < 0 or score < threshold:
        return Found("none", score)
    return at("shingle_fuzzy", score, start, start + len(own))


def _codes(text: str) -> np.ndarray:
    """Trigrams of a text in order as numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


class Sieve:
    """Which of the sources ``locate`` may find in a target, by a bound that no match falls short of.

    A window of a similarity of at least t holds at least t times the source's distinct trigrams, so as many of its places
    hold one of them. This is asked of the whole target first, then of every window; of the windows left the similarity is
    counted. Of a source with an ellipsis, either the whole or every part must pass; texts under three characters must occur
    as they are.
    """

    def __init__(self, sources: list[tuple[str | None, float]]):
        units: list[tuple[str, float]] = []
        self.wanted: list[list[list[int]]] = []
        for source, threshold in sources:
            ways = [[(own, threshold)]] if (own := normalised(source).text) else []
            if own and len(parts := parts_of(source)) > 1:
                ways.append([(p, part_threshold(threshold)) for p in parts])
            self.wanted.append([list(range(len(units) + sum(map(len, ways[:k])), len(units) + sum(map(len, ways[: k + 1])))) for k in range(len(ways))])
            units += [u for way in ways for u in way]
        self.units = [u for u, _ in units]
        keys = [np.unique(_codes(u)) if len(u) >= GRAM else np.empty(0, np.int64) for u in self.units]
        self.size, self.least = [len(k) for k in keys], [t for _, t in units]
        self.need = np.array([np.ceil(t * len(k) - 1e-9) for (_, t), k in zip(units, keys, strict=True)])
        self.blocks = []
        for at in range(0, len(units), BLOCK):
            known = np.unique(np.concatenate(keys[at : at + BLOCK]))
            has = np.zeros((len(keys[at : at + BLOCK]), len(known) + 1), bool)
            for row, k in zip(has, keys[at : at + BLOCK], strict=True):
                row[np.searchsorted(known, k)] = True
            self.blocks.append((at, known, has))

    def _similar(self, unit: int, hit: np.ndarray, before: np.ndarray, width: int) -> bool:
        """Whether a window has the similarity; before has the last place of the same trigram.

        A place is the first of its trigram in the windows that begin after that and hold it: runs of windows, which add up.
        """

        def distinct(at: np.ndarray) -> np.ndarray:
            first = np.maximum(np.maximum(before[at], at - width) + 1, 0)
            return np.cumsum(np.bincount(first, minlength=len(hit) + 1) - np.bincount(at + 1, minlength=len(hit) + 1))[: len(hit) - width + 1]

        common = distinct(np.flatnonzero(hit))
        if common.max() < self.need[unit]:
            return False
        every = distinct(np.arange(len(hit)))
        return bool((common >= (self.least[unit] - 1e-9) * (self.size[unit] + every - common)).any())

    def may_match(self, target: str) -> list[int]:
        """Places of the sources that pass, for a target in normal form."""
        passed = [len(u) < GRAM and u in target for u in self.units]
        if len(target) >= GRAM:
            values, at_place = np.unique(_codes(target), return_inverse=True)
            order = np.argsort(at_place, kind="stable")
            before = np.full(len(order), -1)
            same = at_place[order[1:]] == at_place[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
            for at, known, has in self.blocks:
                if not len(known):
                    continue
                near = np.minimum(np.searchsorted(known, values), len(known) - 1)
                same = known[near] == values
                enough = has[:, near[same]].sum(axis=1) >= self.need[at : at + len(has)]
                column = np.where(same, near, len(known))[at_place] if enough.any() else None
                for k in np.flatnonzero(enough).tolist():
                    width = len(self.units[at + k]) - GRAM + 1
                    if 0 < width <= len(column):
                        hit = has[k][column]
                        sums = np.concatenate([[0], np.cumsum(hit)])
                        passed[at + k] = (sums[width:] - sums[:-width]).max() >= self.need[at + k] and self._similar(at + k, hit, before, width)
        return [i for i, ways in enumerate(self.wanted) if any(all(passed[u] for u in way) for way in ways)]


def candidates(targets: DataFrame, sources: list[tuple], source_id: str, source_type: str, target: str = "target", threshold: float = OTHERWISE) -> DataFrame:
    """The targets with each of the sources (id, text) that ``locate`` may find in them, as columns source_id and source.

    The sources go to every task; the targets need no shuffle.
    """
    shared = targets.sparkSession.sparkContext.broadcast(sources)
    names = targets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sieve = Sieve([(s, threshold) for _, s in own])
        for b in batches:
            for row, text in enumerate(b.column(target).to_pylist()):
                found = sieve.may_match(plain_form(text)) if text else []
                if found:
                    one = b.take(pa.array([row] * len(found)))
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array([own[i][0] for i in found]), pa.array([own[i][1] for i in found], pa.string())], names=[*names, source_id, "source"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in targets.dtypes), f"`{source_id}` {source_type}", "source string"])
    return targets.mapInArrow(run, schema)


def align(pairs: DataFrame, source: str = "source", target: str = "target", kind: str = "kind", thresholds: dict[str, float] | None = None) -> DataFrame:
    """The pairs with status (matched, unmatched or target_missing), method, score, char_start, char_end and threshold.

    Pairs are independent, so this needs no shuffle; of the target only the places of a match return.
    """
    known = thresholds or _thresholds(pairs.sparkSession)
    results = [("status", pa.string()), ("method", pa.string()), ("score", pa.float64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("threshold", pa.float64())]
    keep = [c for c in pairs.columns if c not in {source, target, *(n for n, _ in results)}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, t, k in zip(b.column(source).to_pylist(), b.column(target).to_pylist(), b.column("kind__").to_pylist(), strict=True):
                limit = known.get(k or "", OTHERWISE)
                found = locate(s, t, limit)
                status = "target_missing" if t is None else "unmatched" if found.method == "none" else "matched"
                rows.append((status, *found, limit))
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(results)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, *(n for n, _ in results)])

    kinds = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "status string, method string, score double, char_start long, char_end long, threshold double"])
    return pairs.withColumn("kind__", F.col(kind) if kind in pairs.columns else F.lit(None).cast("string")).mapInArrow(run, schema)
