"""Citations such as "Work/Commentary 3/1-2": which work they name, and which of its numbered parts.

A registry lists the works: name, alternates, short form, formats of their numbers, and of which work one is a commentary. A
format is a list of groups between slashes; a group is

* ``a`` or ``a,b`` or ``a-b``: one number for each field, split at the comma or dash;
* ``§a``: may be left out; if it is there its value begins with §;
* ``{w/v}a``: a number behind one of the words;
* ``<a>``: taken as it is written.

A field ``#a`` is read but not reported. Values may be lists and ranges (1-3,39); a citation gives a row for each combination,
MOST at most, else one row to be looked at by hand. Nothing here needs a session but ``cited`` and ``edges_of``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a citation, and numbers of a range, at most.
MOST = 50
#: Spellings that count as one, words that mean the work itself, phrases that say nothing, words for parts.
SPELLINGS = [("ण्ड", "ंड"), ("ण्ठ", "ंठ"), ("ञ्च", "ंच"), ("ञ्ज", "ंज"), ("न्त", "ंत"), ("न्द", "ंद"), ("म्ब", "ंब"), ("न्व", "ंव"), ("ी", "ि")]
OWN_WORDS, OWN_EXCEPTIONS = ["मूल"], ["मूलाचार"]
NOISE = ["मूल गाथा या टीका", "मूल या टीका"]
PART_WORDS = ["गाथा", "श्लोक", "पंक्ति", "कलश", "परिशिष्ठ", "अधिकार", "अध्याय", "सर्ग", "परिच्छेद", "प्रकरण", "खण्ड", "भाग", "पुस्तक"]
PAGE_WORDS = ["पृष्ठ"]
COMMENTARY_ENDS = [" की टीका", " टीका"]
COMMENTARY = "टीका"
_RANGES = re.compile(r"\d{1,9}(?:-\d{1,9})?(?:\s*,\s*\d{1,9}(?:-\d{1,9})?)*")


class Group(NamedTuple):
    """A group of a format: names of its fields (with their #), what separates them, and what kind of group it is."""

    fields: tuple[str, ...]
    separator: str | None = None
    words: tuple[str, ...] = ()
    optional: bool = False
    verbatim: bool = False


def parse_format(text: str) -> list[Group]:
    """The groups of a format."""
    out = []
    for part in re.findall(r"(?:\{[^}]*\}|<[^>]*>|[^/{<])+", text or ""):
        part = part.strip()
        if not part:
            continue
        if m := re.fullmatch(r"<(.+)>", part):
            out.append(Group((m[1].strip(),), verbatim=True))
        elif m := re.fullmatch(r"\{([^}]+)\}(.+)", part):
            out.append(Group((m[2].strip(),), words=tuple(w.strip() for w in m[1].split("/") if w.strip())))
        else:
            separator = "," if "," in part else "-" if "-" in part else None
            fields = [f.strip() for f in (part.split(separator) if separator else [part])]
            fields = [f for f in fields if f.strip("§ ")]
            if fields:
                out.append(Group(tuple(f.removeprefix("§").strip() for f in fields), separator, optional=all(f.startswith("§") for f in fields)))
    return out


def expand(value: str) -> list[int] | None:
    """1-3,39 as its numbers; null if it is no such list, or a range runs down or is over MOST wide."""
    if not _RANGES.fullmatch(value.strip()):
        return None
    out: list[int] = []
    for part in value.split(","):
        first, _, last = part.strip().partition("-")
        a, b = int(first), int(last or first)
        if b < a or b - a > MOST:
            return None
        out += range(a, b + 1)
    return out


def combined(fields: list[tuple[str, object]]) -> list[list[tuple[str, object]]] | None:
    """One list of fields for each combination of their values; null beyond MOST. Verbatim values are tuples of one text."""
    choices = [[v[0]] if isinstance(v, tuple) else expand(str(v)) or [v] for _, v in fields]
    n = 1
    for c in choices:
        n *= len(c)
    if n > MOST:
        return None
    return [list(zip([name for name, _ in fields], values, strict=True)) for values in product(*choices)]


def normal_name(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    for old, new in SPELLINGS:
        text = text.replace(old, new)
    return re.sub(r"\s*/\s*", "/", text).replace(" ", "")


@dataclass(frozen=True)
class Work:
    name: str
    formats: tuple[tuple[Group, ...], ...] = ()
    commentary_of: str | None = None


class Registry:
    """Works by their names, then by their alternate names, then by their short forms; the first of equal ones holds."""

    def __init__(self, rows: list[dict]):
        self.by: list[tuple[str, dict[str, Work]]] = [("name", {}), ("alternate", {}), ("short", {})]
        for r in rows:
            formats = tuple(tuple(parse_format(f)) for f in r.get("formats") or [])
            work = Work(r["name"], formats, r.get("commentary_of"))
            for (_, known), names in zip(self.by, ([r["name"]], r.get("alternates") or [], [r.get("short")]), strict=True):
                for n in names:
                    if n:
                        known.setdefault(normal_name(n), work)

    def lookup(self, name: str) -> tuple[Work, str] | None:
        key = normal_name(name)
        return next(((known[key], how) for how, known in self.by if key in known), None)


def _without_own_word(name: str) -> str:
    if any(unicodedata.normalize("NFC", name).startswith(x) for x in OWN_EXCEPTIONS):
        return name
    for w in OWN_WORDS:
        for before in (" ", "/"):
            if name.endswith(before + w):
                return name[: -len(w) - 1].rstrip(" /").strip()
    return name


class Named(NamedTuple):
    work: Work
    how: str
    is_commentary: bool = False
    commentary: str = ""


def find_work(name: str, registry: Registry) -> Named | None:
    """The work that a name means, and the commentary that is named behind it; the longest prefix that is a work holds."""

    def known(text: str) -> tuple[Work, str] | None:
        bare = _without_own_word(text)
        return registry.lookup(text) or (registry.lookup(bare) if bare != text else None)

    for form in (name, re.sub(r"\s+", "/", name.strip())):
        if hit := known(form):
            return Named(*hit)
    for end in COMMENTARY_ENDS:
        if name.endswith(end) and (base := name[: -len(end)].strip().rstrip("/").strip()):
            if hit := known(base):
                return Named(*hit, True, COMMENTARY)
            break
    parts = [p.strip() for p in name.split("/")]
    described = {*PART_WORDS, *PAGE_WORDS}
    for cut in range(len(parts) - 1, 0, -1):
        hit = known("/".join(parts[:cut]).strip())
        if not hit:
            continue
        rest = [p for p in parts[cut:] if p]
        if not rest or rest[0].split()[0] in OWN_WORDS or all(p in described for p in rest):
            return Named(*hit)
        while rest and rest[-1] in described:
            rest.pop()
        return Named(*hit, True, "/".join(rest))
    return None


def cleaned(text: str, keep_words: bool = False) -> str:
    """The citation without brackets, dandas and phrases that say nothing; without words for parts that stand alone, if asked."""
    out = re.sub(r"[()]", "", text)
    out = re.sub("[।॥]", " ", out)
    for phrase in NOISE:
        out = out.replace(phrase, " ")
    if not keep_words:
        for w in PART_WORDS:
            out = re.sub(rf"\s+{re.escape(w)}\s+", " ", out)
    return re.sub(r"\s+", " ", out).strip()


def split_numbers(text: str, words: list[str] | None = None) -> tuple[str, str]:
    """The name and the numbers of a citation: it is cut at the first digit or §, or at a word for a part behind a slash before it.

    Groups at the end without any digit go.
    """
    cuts = [m.start() for m in [re.search(r"[\d§]", text)] if m]
    for w in words or []:
        cuts += [m.start(1) for m in [re.search(rf"/\s*({re.escape(w)})(?!\w)", text)] if m]
    if not cuts:
        return text.strip(" /"), ""
    groups = text[min(cuts) :].strip(" /").split("/")
    while groups and not re.search(r"\d", groups[-1]):
        groups.pop()
    return text[: min(cuts)].strip(" /"), "/".join(groups).replace(" ", "")


def read_numbers(numbers: str, groups: tuple[Group, ...]) -> tuple[list[tuple[str, object]], set[str]] | None:
    """Fields and the words that were used, if the numbers follow the format; else null."""
    values = numbers.split("/") if numbers else []
    out: list[tuple[str, object]] = []
    used: set[str] = set()
    k = 0
    for g in groups:
        value = values[k] if k < len(values) else None
        if g.optional and (value is None or not value.startswith("§")):
            continue
        if value is None:
            return None
        k += 1
        if g.verbatim:
            found: list[object] | None = [(value,)]
        elif g.words:
            hit = next(((w, m[0]) for w in g.words if value.startswith(w) and (m := re.match(r"\d{1,9}", value[len(w) :]))), None)
            found = [int(hit[1])] if hit else None
            used |= {hit[0]} if hit else set()
        else:
            parts = value.lstrip("§").split(g.separator) if g.separator else [value.lstrip("§")]
            read = [p if _RANGES.fullmatch(p) and not p.isdecimal() else int(m[0]) if (m := re.match(r"\d{1,9}", p)) else None for p in parts]
            found = read if len(read) == len(g.fields) and None not in read else None
        if found is None:
            return None
        out += [(f, v) for f, v in zip(g.fields, found, strict=True) if not f.startswith("#")]
    return (out, used) if k == len(values) else None


class Citation(NamedTuple):
    """A row: fields are (name, value as text)."""

    work: str | None
    how: str | None
    is_commentary: bool
    commentary: str
    by_hand: bool
    fields: list[tuple[str, str]]


def parse(text: str | None, registry: Registry) -> list[Citation]:
    """The rows of a citation: none named gives one empty row, an unknown work one row to be looked at by hand."""
    name, numbers = split_numbers(cleaned(text or ""))
    if not name:
        return [Citation(None, None, False, "", False, [])]
    named = find_work(name, registry)
    if named is None:
        return [Citation(None, None, False, "", True, [])]
    work = named.work
    out = (work.commentary_of or work.name, named.how, bool(work.commentary_of) or named.is_commentary, work.name if work.commentary_of else named.commentary)
    with_words = split_numbers(cleaned(text, keep_words=True), PART_WORDS)[1]
    read = None
    for groups in work.formats or ((),):
        read = read_numbers(with_words if any(g.words for g in groups) else numbers, groups)
        if read:
            break
    fields, used = read or ([], set())
    known, by_hand = dict(fields), read is None
    # Words with a number behind them, anywhere, name a field too; where both speak and differ, somebody has to look.
    for w in PART_WORDS:
        if w in used or not (m := re.search(rf"(?<!\S){re.escape(w)}\s+(\d{{1,9}})", text)):
            continue
        value = int(m[1])
        if w in known:
            by_hand |= known[w] != value
        elif not by_hand and re.search(rf"(?<!\S){re.escape(w)}\s*\d", with_words) and value in known.values():
            by_hand = True
        known[w] = value
    rows = None if by_hand else combined(list(known.items()))
    if rows is None:
        kept = list(known.items()) if by_hand else []
        return [Citation(*out, True, [(f, str(v[0] if isinstance(v, tuple) else v)) for f, v in kept])]
    return [Citation(*out, False, [(f, str(v)) for f, v in row]) for row in rows]


SCHEMA = "place int, work string, how string, is_commentary boolean, commentary string, by_hand boolean, fields array<struct<name:string,value:string>>"


def cited(citations: DataFrame, registry: list[dict], text: str = "text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The rows of every citation, with the columns of keep. The registry, a table of configuration, goes to every task."""
    shared = citations.sparkSession.sparkContext.broadcast(registry)
    kinds = dict(citations.dtypes)
    field = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    types = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), field]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Registry(shared.value)
        for b in batches:
            found = [(i, k, *c) for i, t in enumerate(b.column(text).to_pylist()) for k, c in enumerate(parse(t, known))]
            columns = list(zip(*found, strict=True)) or [()] * 8
            columns[7] = [[{"name": n, "value": v} for n, v in fields] for fields in columns[7]]
            at = pa.array(columns[0], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=[*keep, *(s.split(" ")[0] for s in SCHEMA.split(", "))])

    return citations.select(*dict.fromkeys((*keep, text))).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), SCHEMA]))


def edges_of(rows: DataFrame, parent: str, parent_label: str, place: list[str]) -> DataFrame:
    """Edges from what citations name to the block's parent: one for each resolved row that names a verse, interlude or page.

    Types are CONTAINS_DEFINITION for terms and MENTIONS_TOPIC for topics; a row without a number names nothing.
    """
    one = lambda name: F.get(F.filter("fields", lambda f: f["name"] == name), 0)["value"]
    value = lambda *names: F.coalesce(*map(one, names))
    kind = F.lit("CONTAINS_DEFINITION" if parent_label == "keyword" else "MENTIONS_TOPIC")
    verse, interlude, page = value("गाथा", "श्लोक", "सूत्र"), value("कलश"), value("पृष्ठ")
    own = F.concat_ws(":", "work", F.when(F.col("is_commentary"), F.col("commentary")))
    node = F.when(interlude.isNotNull(), F.concat(own, F.lit(":कलश:"), interlude)).when(verse.isNotNull(), F.concat(own, F.lit(":गाथा:"), verse)).when(page.isNotNull(), F.concat(own, F.lit(":पृष्ठ:"), page))
    label = F.when(interlude.isNotNull(), "Kalash").when(verse.isNotNull(), F.when(F.col("is_commentary"), "GathaTeeka").otherwise("Gatha")).when(page.isNotNull(), "Page")
    good = rows.filter("NOT by_hand AND work IS NOT NULL").withColumn("src", node).withColumn("src_label", label).filter("src IS NOT NULL")
    return good.select(kind.alias("type"), "src", "src_label", F.col(parent).alias("dst"), F.lit(parent_label).alias("dst_label"), *place).distinct()
