"""Column functions on hierarchical keys: build, parse, address and compare them; no user-defined functions.

A work with a compound scheme numbers its verses by several fields, such as chapter and verse: ``fields`` is an array of their
names in order, null or empty for works that number verses by one field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import slug

#: Names of the field that numbers verses.
VERSE_FIELDS = ("गाथा", "श्लोक", "सूत्र", "दोहक", "वार्तिक")


def child_key(parent: Column, heading: Column) -> Column:
    """The key of a heading under its parent's."""
    return F.concat_ws(":", parent, slug(heading))


def segment_name(work: Column, field: Column) -> Column:
    """A field's name without the name of its work in front."""
    return F.when(F.startswith(field, work) & (F.length(field) > F.length(work)), F.substr(field, F.length(work) + 1)).otherwise(field)


def is_compound(fields: Column) -> Column:
    return F.coalesce(F.size(fields) > 0, F.lit(False))


def suffix_of(work: Column, fields: Column, values: Column) -> Column:
    """name:value pairs of a compound key; null if a value is missing or empty."""
    pairs = F.zip_with(fields, values, lambda f, v: F.when(v != "", F.concat(segment_name(work, f), F.lit(":"), v)))
    return F.when(is_compound(fields) & (F.size(fields) == F.size(values)) & ~F.exists(pairs, lambda p: p.isNull()), F.array_join(pairs, ":"))


def values_of(work: Column, fields: Column, key: Column) -> Column:
    """The values of a key's fields in order; null if the key does not follow the scheme."""
    parts = F.split(F.substr(key, F.length(work) + 2), ":")
    names = F.transform(fields, lambda f, i: F.get(parts, 2 * i) == segment_name(work, f))
    found = F.transform(fields, lambda f, i: F.get(parts, 2 * i + 1))
    good = F.startswith(key, F.concat(work, F.lit(":"))) & ~F.exists(names, lambda n: ~F.coalesce(n, F.lit(False))) & ~F.exists(found, lambda v: v.isNull())
    return F.when(is_compound(fields) & good, found)


def verse_field(work: Column, fields: Column) -> Column:
    """The place (from 0) of the field that numbers verses: the first by name, else the last."""
    named = F.filter(F.transform(fields, lambda f, i: F.when(segment_name(work, f).isin(*VERSE_FIELDS), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(named, 0), F.size(fields) - 1)


def key_of_path(work: Column, fields: Column, path: Column) -> Column:
    """The key that an address such as 1,2 names; null if it has another number of values than the work has fields."""
    return F.when(is_compound(fields), F.concat(work, F.lit(":"), suffix_of(work, fields, F.split(path, ",")))).otherwise(F.concat(work, F.lit(":गाथा:"), path))


def compact(work: Column, fields: Column, key: Column, number: Column) -> Column:
    """A verse's address: its values joined by commas, else its number."""
    return F.coalesce(F.array_join(values_of(work, fields, key), ","), number)


def identifier(work: Column, fields: Column, key: Column, number: Column) -> Column:
    """(fields of (name, label, value), compact, is_compound) of a verse."""
    values = values_of(work, fields, key)
    named = F.zip_with(fields, values, lambda f, v: F.struct(f.alias("name"), segment_name(work, f).alias("label"), v.alias("value")))
    single = F.array(F.struct(F.lit("गाथा").alias("name"), F.lit("गाथा").alias("label"), number.alias("value")))
    none = F.array().cast("array<struct<name:string,label:string,value:string>>")
    return F.struct(F.when(is_compound(fields), F.coalesce(named, none)).otherwise(single).alias("fields"), compact(work, fields, key, number).alias("compact"), is_compound(fields).alias("is_compound"))


def same_numbers(values: Column, wanted: Column) -> Column:
    """Whether two lists of values are equal as numbers; a value that is no number equals none."""
    a, b = (F.transform(x, lambda v: v.try_cast("int")) for x in (values, wanted))
    return F.coalesce((F.size(a) == F.size(b)) & ~F.exists(a, lambda v: v.isNull()) & (a == b), F.lit(False))


def trailing_label(suffix: Column, label: str) -> Column:
    """The suffix with a label before its last value."""
    head = F.regexp_extract(suffix, r"^(.*):([^:]*)$", 1)
    return F.when(F.contains(suffix, F.lit(":")), F.concat(head, F.lit(f":{label}:"), F.regexp_extract(suffix, r"([^:]*)$", 1))).otherwise(F.concat(F.lit(f"{label}:"), suffix))


def verse_number(key: Column) -> Column:
    """The last number in a key, as it is written; null without one."""
    found = F.regexp_extract(key, r"(?:^|:)([0-9]+)(?!.*(?:^|:)[0-9]+(?:$|:))(?:$|:)", 1)
    return F.when(found != "", found)


def key_segment(work: Column, fields: Column, verse_key: Column) -> Column:
    """How a verse is named within the keys of its commentaries: its whole suffix under a compound scheme, else its number."""
    prefix = F.concat(work, F.lit(":"))
    last = F.element_at(F.split(verse_key, ":"), -1)
    return F.when(is_compound(fields) & F.startswith(verse_key, prefix), F.substr(verse_key, F.length(prefix) + 1)).otherwise(last)


def any_width(key: Column) -> Column:
    """The key with its last numeric part without leading zeros, by which keys of any padding are equal."""
    return F.regexp_replace(key, r"(^|:)0+([0-9]+)(?=(?::[^:]*[^:0-9][^:]*)*$)", "$1$2")


def numbered(parent: Column, place: Column, width: int = 2) -> Column:
    """table:parent:01 and so on."""
    return F.concat(F.lit("table:"), parent, F.lit(":"), F.lpad(place.cast("string"), F.greatest(F.lit(width), F.length(place.cast("string"))), F.lit("0")))


def parts_of_key(label: Column, key: Column) -> Column:
    """(work, commentary, publication, number, book) that the key of a node of a label names; parts that it does not name are null.

    Verses are work:...:number (all that follows the work under a compound scheme), commentaries on them
    work:commentary:...:टीका:number, paraphrases work:commentary:publication:...:भावार्थ:number, interludes
    work:commentary:कलश:number, pages work:commentary:publication[:पुस्तक:book]:पृष्ठ:number.
    """
    some = lambda c: F.when(c != "", c)
    got = lambda pattern, k=1: some(F.regexp_extract(key, pattern, k))
    parts = F.split(key, ":")
    first = lambda n: F.array_join(F.slice(parts, 1, n), ":")
    rest = F.regexp_extract(key, r"^[^:]*:(.*)$", 1)
    page = r"^(.*?)(?::पुस्तक:([^:]*))?:पृष्ठ:([^:]*)$"
    before = F.coalesce(got(r"^(.*):कलश:भावार्थ:[^:]*$"), got(page))
    commentary = F.when(label == "Kalash", got(r"^(.*):कलश:[^:]*$")).when(label.isin("GathaTeeka", "GathaTeekaBhaavarth"), first(2)).when(label.isin("KalashBhaavarth", "Page"), F.regexp_replace(before, ":[^:]*$", ""))
    publication = F.when(label == "GathaTeekaBhaavarth", F.get(parts, 2)).when(label.isin("KalashBhaavarth", "Page"), F.regexp_extract(before, "([^:]*)$", 1))
    number = (
        F.when(label == "Gatha", F.coalesce(some(F.regexp_extract(rest, "^गाथा:(.*)$", 1)), some(rest)))
        .when(label == "GathaTeeka", got(r":टीका:([^:]*)$"))
        .when(label.isin("GathaTeekaBhaavarth", "KalashBhaavarth"), got(r":भावार्थ:([^:]*)$"))
        .when(label == "Kalash", got(r":कलश:([^:]*)$"))
        .when(label == "Page", got(page, 3))
    )
    return F.struct(some(F.get(parts, 0)).alias("work"), some(commentary).alias("commentary"), some(publication).alias("publication"), number.alias("number"), F.when(label == "Page", got(page, 2)).alias("book"))
