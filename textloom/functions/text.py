"""Column functions on text, keys and arrays; no user-defined functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is a word in trigram similarity: letters, marks and digits (marks, or Devanagari would split at every vowel sign).
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
#: Hindi inflection suffixes in the order in which they are tried.
SUFFIXES = ["ियाँ", "ियों", "ोंमें", "ोंकी", "ोंका", "ोंके", "ें", "ों", "ाओं", "ाएँ", "ाएं", "ीं", "ी", "ये", "या", "का", "के", "की", "में", "से", "पर", "को", "ा", "े", "ो"]
#: Vowel signs and marks of which one at the end of a token may go, and a transliterated nasal.
END_MARKS = "ािीुूृेैोौंः्ॐm"
#: Connectives without a topic of their own.
STOP_WORDS = ["व", "और", "या", "के", "का", "की", "को", "में", "से", "पर", "है", "हैं", "तथा", "एवं", "तो", "ही", "भी"]
#: Particles that a search in lists leaves out, and the least length of its tokens.
LIST_STOP_WORDS, LIST_LEAST = ["की", "के", "का", "को", "कि", "व", "में", "से", "पर", "और", "है", "हैं", "तथा", "या", "एवं", "हेतु", "एक"], 3
#: Marks within words (virama and joiners), and separators of the parts of a key.
IN_WORD = "्\u200c\u200d"
SEPARATORS = r"/\-:।॥|"


def trigrams(text: Column) -> Column:
    """The set of trigrams of a text: of each word, padded by two spaces in front and one behind."""
    words = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared elements over all elements of two sets; ``empty`` if both are (0 for words, 1 in alignment)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def literal_like(text: Column, part: str) -> Column:
    """Case-insensitive substring test in which % and _ stand for themselves."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def coverage(segments: Column, tokens: list[str]) -> Column:
    """The share of tokens that begin some segment; 1 without tokens."""
    if not tokens:
        return F.lit(1.0)
    hits = [_begins(segments, t) for t in tokens]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / len(tokens)


def _begins(segments: Column, token: str) -> Column:
    return F.exists(segments, lambda s: F.startswith(s, F.lit(token))).cast("int")


def segments(key: Column) -> Column:
    """Parts of a hierarchical key, lower case, without marks within words and without empty ones."""
    parts = F.filter(F.split(F.lower(key), rf"[\s{SEPARATORS}]+"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, f"[{IN_WORD}]", ""))


def folded(token: Column) -> Column:
    """A token as it is compared with the parts of keys: lower case, without marks within words, separators and white space."""
    return F.regexp_replace(F.lower(token), rf"[{IN_WORD}{SEPARATORS}\s]", "")


def coverage_tokens(tokens: Column, stop: list[str] = STOP_WORDS, least: int = 2) -> Column:
    """The folded tokens of an array in order, once each, without stop words and without those shorter than ``least``."""
    kept = F.filter(tokens, lambda t: ~F.trim(t).isin(*stop)) if stop else tokens
    return F.array_distinct(F.filter(F.transform(kept, folded), lambda t: F.length(t) >= least))


def listing_tokens(query: Column) -> Column:
    """The words of a query that a search in lists uses, in order, with repeats."""
    return F.filter(F.split(query, r"\s+"), lambda t: ~t.isin(*LIST_STOP_WORDS) & (F.length(t) >= LIST_LEAST))


def covered(parts: Column, tokens: Column) -> Column:
    """The share of an array of tokens that begin some part; 1 without tokens."""
    hits = F.size(F.filter(tokens, lambda t: F.exists(parts, lambda s: F.startswith(s, t))))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens)).otherwise(F.lit(1.0))


def strip_end_mark(token: Column) -> Column:
    """The token without one vowel sign or mark at its end; null if it has none or nothing is left."""
    ends = F.contains(F.lit(END_MARKS), F.right(token, F.lit(1))) & (F.length(token) > 1)
    return F.when(ends, F.substr(token, F.lit(1), F.length(token) - 1))


def without_joiners(token: Column) -> Column:
    """The token without zero-width joiners, trimmed."""
    return F.trim(F.translate(token, "\u200c\u200d", ""))


def squeezed(text: Column) -> Column:
    """White space within lines as one space, lines trimmed, empty lines gone."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\u00a0]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def term_of_url(url: Column, before: str = "/wiki/") -> Column:
    """The term that a page's address names: what follows ``before``, without query and fragment, decoded, with spaces."""
    part = F.regexp_extract(url, rf"{re.escape(before)}([^?#]*)", 1)
    # A plus stands for itself in a path; malformed escapes give null.
    term = F.replace(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))
    return F.when(part != "", term)


def display(*names: Column) -> Column:
    """The first of the names that is neither null nor empty; else the empty text."""
    return F.coalesce(*[F.when(n != "", n) for n in names], F.lit(""))


def kind_of(label: Column, kinds: dict[str, str], otherwise: str = "topic") -> Column:
    """The kind that a label stands for."""
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(known, label), F.lit(otherwise))


def highlighted(text: Column, start: Column, end: Column) -> Column:
    """before, match and after by offsets in code points; offsets beyond the text are cut, and a null one gives no match."""
    n = F.length(text)
    a = F.least(F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)), n).cast("int")
    b = F.least(F.greatest(F.coalesce(end, F.lit(0)), a), n).cast("int")
    return F.struct(F.substr(text, F.lit(1), a).alias("before"), F.substr(text, a + 1, b - a).alias("match"), F.substr(text, b + 1).alias("after"))


def bracketed(text: Column) -> Column:
    """The terms in square brackets, in order, once each."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), F.trim), lambda t: t != ""))


def bracket_parts(text: Column) -> Column:
    """A text as its parts (text, is_term) in order; empty parts are left out."""
    pattern = r"\[([^\[\]]*)\]"
    gaps, terms = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    both = F.arrays_zip(gaps.alias("gap"), terms.alias("term"))
    parts = F.flatten(F.transform(both, lambda x: F.array(F.struct(x["gap"].alias("text"), F.lit(False).alias("is_term")), F.struct(x["term"].alias("text"), F.lit(True).alias("is_term")))))
    return F.filter(parts, lambda p: p["text"].isNotNull() & (p["text"] != ""))


def signed_digits(text: Column) -> Column:
    """A footnote's marker as a number: digits of either script, or the negative count of its asterisks; null if it is neither."""
    stars = F.when(text.rlike(r"^\*+$"), -F.length(text))
    return F.coalesce(stars.cast("int"), ascii_digits(text).try_cast("int"))


def removed(text: Column, parts: Column) -> Column:
    """The text without each of the parts, with brackets that are left empty and spaces that are left over gone."""
    out = F.aggregate(parts, text, lambda t, p: F.when(p != "", F.replace(t, p, F.lit(""))).otherwise(t))
    for pattern, by in ((r"\(\s*[,;]*\s*\)|\[\s*\]", ""), (r"\s+([,;।॥.)])", "$1"), (r"([(])\s+", "$1"), (r"([,;])(\s*[,;])+", "$1"), (r"[\s\u00a0]+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(F.regexp_replace(out, r"^[\s,;]+|[\s,;]+$", ""))


def link_range(target: Column) -> Column:
    """Targets of a link such as 3.4-6: 3.4, 3.5, 3.6; one that is no range of at most fifty stands for itself."""
    head, a, b = (F.regexp_extract(target, r"^(.*?)(\d{1,9})\s*-\s*(\d{1,9})$", k) for k in (1, 2, 3))
    first, last = a.try_cast("int"), b.try_cast("int")
    some = first.isNotNull() & (last > first) & (last - first < 50)
    return F.when(some, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.concat(head, i.cast("string")))).otherwise(F.array(target))


def see_also_removed(text: Column, triggers: list[str]) -> Column:
    """The text without bracketed references that begin with one of the triggers, such as (see above)."""
    either = "|".join(map(re.escape, triggers))
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"\s*[\[(]\s*(?:{either})[^\])]*[\])]", ""), r"[\s\u00a0]+", " "))


def label_before(text: Column, triggers: list[str]) -> Column:
    """What stands before the first trigger, without the dash, colon or bracket that leads to it; null without a trigger."""
    either = "|".join(map(re.escape, triggers))
    return F.when(text.rlike(either), F.trim(F.regexp_extract(text, rf"(?s)^(.*?)[\s\-–—:(\[]*(?:{either})", 1)))




def breadcrumb(key: Column) -> Column:
    """The parents in a key: split at colons if it has any, else at slashes; the leaf goes, hyphens become spaces."""
    parts = F.when(F.contains(key, F.lit(":")), F.split(key, ":")).otherwise(F.split(key, "/"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.replace(p, F.lit("-"), F.lit(" ")))


def strip_suffix(token: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The token without the first suffix of the list that it ends with and that leaves two characters; null if none does."""
    return F.coalesce(*[F.when(F.endswith(token, F.lit(s)) & (F.length(token) > len(s) + 1), F.substr(token, F.lit(1), F.length(token) - len(s))) for s in suffixes])


def pick_language(texts: Column, langs: tuple[str, ...] = ("hin", "hi"), first_otherwise: bool = False) -> Column:
    """The text in one of the languages from an array of (lang, script, text); else the first text, or the empty one."""
    wanted = F.get(F.filter(texts, lambda t: t["lang"].isin(*langs)), 0)["text"]
    return F.coalesce(wanted, F.get(texts, 0)["text"], F.lit("")) if first_otherwise else F.coalesce(wanted, F.lit(""))


def capped(text: Column, length: int = 1500) -> Column:
    """At most so many code points, and an ellipsis for the rest."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def canonical_key(key: Column) -> Column:
    """The key with leading zeros removed from every numeric part."""
    return F.regexp_replace(key, r"(^|:)0+(?=[0-9]+(?::|$))", "$1")


def parent_path(path: Column) -> Column:
    """The dotted path without its last step; null at the top."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", ""))


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s*[0-9.]+\s*", "")), r"[^\p{L}\p{M}\p{N}\s-]", "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", "-"), r"-{2,}", "-")


def document_id(key: Column) -> Column:
    """24 hex digits that depend on the key alone."""
    return F.substring(F.sha1(key), 1, 24)


def expand_ranges(text: Column, most: int = 50) -> Column:
    """Numbers of a list such as 1-3,39; null if a part is no number or a span is over the limit."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "-"))
    ends = F.transform(parts, lambda p: F.struct(F.get(p, 0).try_cast("int").alias("a"), F.coalesce(F.get(p, 1), F.get(p, 0)).try_cast("int").alias("b")))
    bad = F.exists(ends, lambda e: e["a"].isNull() | e["b"].isNull() | (e["b"] < e["a"]) | (e["b"] - e["a"] >= most))
    return F.when(bad.eqNullSafe(False), F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], e["b"]))))


def page_offset(page: Column, bounds: Column) -> Column:
    """The offset of the first (up_to, offset) whose bound holds the page, else the last one's."""
    return F.coalesce(F.get(F.filter(bounds, lambda b: page <= b["up_to"]), 0)["offset"], F.try_element_at(bounds, F.lit(-1))["offset"])


def html_text(html: Column) -> Column:
    """Text of simple markup: scripts, styles and comments go, breaks become newlines, tags go, common entities are read."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def links(html: Column) -> Column:
    """Targets of the anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def ordered_trigrams(text: Column) -> Column:
    """All trigrams of a text in order, with repeats."""
    words = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def word_similarity(phrase: Column, text: Column) -> Column:
    """The greatest similarity of the phrase's trigrams and a run of the text's; for names and titles, not long texts.

    The best run begins and ends with a trigram of the phrase, so only such runs are compared.
    """
    wanted, of = trigrams(phrase), ordered_trigrams(text)
    hits = F.filter(F.transform(of, lambda g, i: F.when(F.array_contains(wanted, g), i + 1)), lambda i: i.isNotNull())
    scores = F.flatten(F.transform(hits, lambda a: F.transform(F.filter(hits, lambda b: b >= a), lambda b: jaccard(wanted, F.array_distinct(F.slice(of, a, b - a + 1))))))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def ascii_digits(text: Column) -> Column:
    """Devanagari digits as ASCII ones."""
    return F.translate(text, "०१२३४५६७८९", "0123456789")


def padded_range(text: Column, separator: str = "-") -> Column:
    """098-100 as its numbers, padded to the width of the first; one number, or three and more, as they are listed."""
    parts = F.split(text, separator)
    ends = F.transform(parts, lambda p: p.try_cast("int"))
    full = F.transform(F.sequence(ends[0], ends[1]), lambda i: F.lpad(i.cast("string"), F.length(parts[0]), F.lit("0")))
    return F.when((F.size(parts) == 2) & F.get(ends, 0).isNotNull() & (F.get(ends, 0) <= F.get(ends, 1)), full).otherwise(parts)


def verses(text: Column) -> Column:
    """(number, text) of the verses of a text; each ends with its number between double or single dandas, or in brackets."""
    marker = r"(?:॥|।)\s*([0-9०-९]+)\s*(?:॥|।)|\(([0-9०-९]+)\)"
    numbers = F.transform(F.regexp_extract_all(text, F.lit(marker), F.lit(0)), lambda m: ascii_digits(F.regexp_replace(m, r"[^0-9०-९]", "")).try_cast("long"))
    return F.zip_with(numbers, F.slice(F.split(text, marker), F.lit(1), F.size(numbers)), lambda n, t: F.struct(n.alias("number"), F.trim(t).alias("text")))


def word_offsets(words: Column, text: Column) -> Column:
    """(word, start) of each word in order: from the end of the last one on, else anywhere, else null; counted from 0."""
    empty = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<word:string,start:int>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        ahead, anywhere = F.position(w, text, acc["cursor"]), F.position(w, text)
        at = F.when(ahead > 0, ahead).when(anywhere > 0, anywhere)
        return F.struct(F.when(at.isNotNull(), at + F.length(w)).otherwise(acc["cursor"]).alias("cursor"), F.concat(acc["out"], F.array(F.struct(w.alias("word"), (at - 1).alias("start")))).alias("out"))

    return F.aggregate(words, empty, step, lambda acc: acc["out"])


def numeric_order(key: Column) -> list[Column]:
    """Sort columns for hierarchical keys: numeric parts by value, keys without a last number behind the others."""
    numbers = F.transform(F.split(key, ":"), lambda p: F.coalesce(ascii_digits(p).try_cast("long"), F.lit(-1).cast("long")))
    return [F.element_at(numbers, -1) < 0, numbers, key]
