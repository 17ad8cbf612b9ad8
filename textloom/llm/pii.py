"""Personal data: base patterns, and terms that disclose it by corpus co-occurrence.

Base spans of four kinds are found by pattern (leftmost, non-overlapping for each kind; matches that fail their check
are dropped without retry). Each base value is a protected entity. A term (a word of letters) that stands near an
entity in at least MIN_TEXTS different texts discloses it by the pointwise mutual information of the two,
PMI = log(N c / (n_term n_entity)), as a share of the entity's information content log(N / n_entity); N, c and n count
different texts over the whole corpus. A share of at least DISCLOSURE is the same as n_term of at most
c (N / n_entity)^(1 - DISCLOSURE); the greatest such limit of a term over its entities decides. Disclosing terms are spans
of kind ``term`` wherever they occur beside the base spans, and are generalised or removed in the sanitised text.

Positions are code points, ends exclusive. Defined results: a null text counts as empty; rows with equal ids are
treated one by one, and equal texts count once in the statistics; an entity that is in every text discloses nothing and is
not disclosed; an empty table gives an empty one; extra columns are left out (sanitised keeps all). Very long texts cost
time in their length and in the number of their matches. Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import stored

MIN_TEXTS = 3
DISCLOSURE = 0.9
#: Code points on either side of a base span that are its context.
CONTEXT = 80
#: Disclosing terms up to this many are broadcast.
BROADCAST_TERMS = 50_000
#: Texts that occur more than once, up to which their hashes (16 bytes each) are broadcast.
BROADCAST_KEYS = 500_000
KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. What may not be given back is possessive, and a match begins where its first run
#: does or where the last match ended, which changes no match but keeps long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.(?!$)|$)){4}$"
WORDS = r"\p{L}{3,}"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: A span: its code points, its bytes (from, to) and what it says.
SPAN = "array<struct<start:bigint,end:bigint,from:bigint,to:bigint,value:string>>"
#: Sums are carried on over so many items, then over so many sums, and so on.
RUN = 64


def _each(kind: str, of: Callable[[str, Column], Column]) -> Column:
    """of(kind, span) for the spans of the kind."""
    return F.transform(kind, lambda s: of(kind, s))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    digit = lambda i: F.substr(turned, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, v: a + v, levels: int = 3) -> Column:
    """The sum (or what else op makes, from 0) of all values before each.

    An array that grows in an aggregate is copied for each item, so only runs of RUN items are summed that way; the sums of
    the runs are carried on in the same manner. The time is linear for some RUN ** (levels + 1) items.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    carry = lambda x: F.aggregate(x, start, lambda a, v: F.struct(op(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    if not levels:
        return carry(values)
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(RUN)), lambda i: F.slice(x, i, F.lit(RUN)))
    add = lambda runs: F.zip_with(runs, running(F.transform(runs, lambda run: F.aggregate(run, zero, lambda a, v: op(a, v))), op, levels - 1), lambda run, base: F.transform(carry(run), lambda v: op(v, base)))
    return _let(values, lambda x: F.flatten(_let(cut(x), add)))




def matches(text: Column, pattern: str | Column) -> Column:
    """All matches as SPAN: the gaps of a split and the matches alternate, and their lengths add up."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def starts(gaps: Column, hits: Column, length: Callable[[Column], Column]) -> Column:
        before = running(F.zip_with(gaps, hits, lambda g, h: (length(g) + length(h)).cast("bigint")))
        return F.zip_with(before, gaps, lambda at, g: at + length(g))

    def placed(gaps: Column, hits: Column) -> Column:
        both = F.arrays_zip(starts(gaps, hits, F.length).alias("start"), starts(gaps, hits, F.octet_length).alias("from"), hits.alias("value"))
        return F.transform(both, lambda x: F.struct(x["start"], (x["start"] + F.length(x["value"])).alias("end"), x["from"], (x["from"] + F.octet_length(x["value"])).alias("to"), x["value"]))

    found = _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: _let(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda gaps: placed(gaps, hits)))
    return found.cast(SPAN)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    need = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.when(need, found).otherwise(F.array().cast(SPAN))


def _context(data: Column, span: Column) -> Column:
    """Words of letters near a span of a text's bytes, lower case, as they are counted in whole texts; what an edge of the context cuts is left out.

    Each side is taken with one code point beyond the context, so that the edge shows whether a word goes on.
    """
    most = 4 * (CONTEXT + 2)
    begin = F.greatest(span["from"] - most, F.lit(0)).cast("int")
    left = F.right(F.substr(data, begin + 1, span["from"].cast("int") - begin).cast("string"), F.lit(CONTEXT + 1))
    left = F.when(F.length(left) > CONTEXT, F.regexp_replace(left, r"(?s)\A(?:\p{L}+|.)", "")).otherwise(left)
    right = F.left(F.substr(data, span["to"].cast("int") + 1, F.lit(most)).cast("string"), F.lit(CONTEXT + 1))
    right = F.when(F.length(right) > CONTEXT, F.regexp_replace(right, r"(?s)(?:(?<!\p{L})\p{L}+|.)\z", "")).otherwise(right)
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(left, F.lit(" "), right)), F.lit(WORDS), F.lit(0)))


def _key(text: Column) -> Column:
    """Two hashes of a text, by which equal texts are told."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every document (doc_id, text) by kind, two hashes of its text, and its entities with their contexts."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("key", _key(F.col("t")))
    rows = rows.select("doc_id", "t", "key", *[base_spans(F.col("t"), k).alias(k) for k in KINDS])
    entity = lambda k, v: F.concat(F.lit(k + ":"), F.lower(v) if k == "email" else v if k == "ip" else _digits(v))
    near = _let(F.col("t").cast("binary"), lambda data: F.concat(*[_each(k, lambda k, s: F.struct(entity(k, s["value"]).alias("entity"), _context(data, s).alias("terms"))) for k in KINDS]))
    return rows.withColumn("near", near).drop("t")


def disclosing_terms(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Disclosing terms (term), and (key, terms) of the texts that have one; None if there are none.

    The words of all texts are counted by aggregation alone; only the terms near entities, and then only those that
    disclose, are joined to anything.
    """
    near = rows.select("key", F.explode("near").alias("x")).select("key", "x.entity", "x.terms")
    seen = near.select("entity", "key").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= MIN_TEXTS)
    pairs = near.select("entity", "key", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= MIN_TEXTS)
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    texts = keys.count()
    most = F.max(F.col("c") * F.pow(texts / F.col("n_entity"), F.lit(1 - DISCLOSURE)))
    limits = stored(pairs.join(seen, "entity").filter(F.col("n_entity") < texts).groupBy("term").agg(most.alias("most")), "limits")
    if limits.isEmpty():
        return None
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(_key(text).alias("key"), text.alias("t"))
    # Of equal texts one counts; the others are few enough to be told by a broadcast, or joined.
    repeated = stored(keys.filter("n > 1").select("key"), "repeated")
    known = F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated
    once = keyed.join(known, "key", "left_anti").unionByName(keyed.join(known, "key", "left_semi").dropDuplicates(["key"]))
    often = once.select(F.explode(_words("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    terms = stored(limits.join(often, "term").filter(F.col("n_term") <= F.col("most") * (1 + 1e-12)).select("term"), "terms")
    n = terms.count()
    if not n:
        return None
    small = F.broadcast if n <= BROADCAST_TERMS else (lambda x: x)
    having = keyed.select("key", F.explode(_words("t")).alias("term")).join(small(terms), "term")
    return terms, stored(having.groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms")), "having")


def _words(text: str) -> Column:
    """The different words of letters of a text, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, and the arrays email, ip, card, phone and term of (start, end, from, to, value) of every document."""
    rows = stored(scan(docs), "personal")
    found = disclosing_terms(rows, docs)
    rows = rows.drop("near")
    if found is None:
        return rows.withColumn("term", F.array().cast(SPAN))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(_key(text).alias("key"), text.alias("t")).join(found[1], "key").dropDuplicates(["key"])
    # The terms of a text are letters alone; a match is a whole run of letters.
    any_term = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    words = keyed.select("key", F.filter(matches(F.col("t"), any_term), lambda s: F.array_contains("terms", F.lower(s["value"]))).alias("words"))
    rows = rows.join(words, "key", "left")
    base = F.concat(*KINDS)
    apart = F.filter("words", lambda w: ~F.exists(base, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return rows.withColumn("term", F.coalesce(apart, F.array().cast(SPAN))).drop("words")


def _listed(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.concat(*[_each(k, lambda k, s: F.concat_ws(":", F.lit(k), s["start"], s["end"])) for k in kinds]), ",")


def _cleaned(data: Column, spans: Column) -> Column:
    """The text of the bytes with each span (from, to, label), given in the order of their starts, replaced by its label.

    A span opens a gap if all before it end at or before its start; spans of one gap are replaced together by its first label.
    """

    def filled(opens: Column, last: Column) -> Column:
        until = F.concat(F.transform(F.slice(opens, F.lit(2), F.size(opens)), lambda s: s["before"]), F.array(last))
        since = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(until, F.lit(1), F.size(opens) - 1))
        part = lambda at, end: F.substr(data, at.cast("int") + 1, (end - at).cast("int")).cast("string")
        kept = F.zip_with(since, opens, lambda at, s: F.concat(part(at, s["from"]), s["label"]))
        return F.concat(F.array_join(kept, ""), part(last, F.octet_length(data).cast("bigint")))

    ends = F.transform(spans, lambda s: s["to"])
    marked = F.zip_with(spans, running(ends, F.greatest), lambda s, before: F.struct(s["from"], s["label"], before.alias("before")))
    return _let(F.filter(marked, lambda s: s["from"] >= s["before"]), lambda opens: filled(opens, F.array_max(ends)))


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with base spans replaced by their kind and disclosing terms by a general word.

    A term that has a capital becomes [NAME], another is removed. Overlapping spans are replaced together.
    """
    found = spans(docs).select("key", *KINDS, "term").dropDuplicates(["key"])
    found = found.filter(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in (*KINDS, "term")]))
    label = lambda k, v: F.when(v != F.lower(v), "[NAME]").otherwise("") if k == "term" else F.lit(LABELS[k])
    every = F.sort_array(F.concat(*[_each(k, lambda k, s: F.struct(s["from"], s["to"], label(k, s["value"]).alias("label"))) for k in (*KINDS, "term")]))
    found = found.select(F.col("key").alias("key_"), every.alias("spans_"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("key_", _key(text)).join(found, "key_", "left")
    clean = _let(text.cast("binary"), lambda data: _let(F.col("spans_"), lambda s: _cleaned(data, s)))
    return rows.withColumn("text", F.when(F.col("spans_").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)


def op9_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed((*KINDS, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"))
