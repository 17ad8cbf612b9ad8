"""Column functions on nested blocks and their references; no user-defined functions.

A block is a struct (kind, text, translation, references), a reference a struct (inline, work_name, commentary_name, fields),
a field a struct (field, value). Null arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import capped

#: Kinds of blocks without text of their own, and the cap of a text.
NO_TEXT = ("see_also", "table")
CAP = 1500
REFERENCE = "struct<inline:boolean,work_name:string,commentary_name:string,fields:array<struct<field:string,value:string>>>"
BLOCK = f"struct<kind:string,text:string,translation:string,references:array<{REFERENCE}>>"
KEY = "struct<work:string,verse:int,commentary:string,page:int>"


def _some(value: Column) -> Column:
    return F.when(value != "", value)


def _list(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.array().cast(f"array<{kind}>"))


def has_text(block: Column) -> Column:
    """Whether a block shows anything: its kind has text, and its text or translation is more than white space."""
    shown = F.coalesce(F.trim(block["text"]), F.lit("")) != ""
    return ~F.coalesce(block["kind"], F.lit("")).isin(*NO_TEXT) & (shown | (F.coalesce(F.trim(block["translation"]), F.lit("")) != ""))


def block_text(block: Column, cap: int = CAP) -> Column:
    """The translation, trimmed, else the text as it is, capped; empty for a kind without text."""
    raw = F.coalesce(_some(F.trim(block["translation"])), block["text"], F.lit(""))
    return F.when(F.coalesce(block["kind"], F.lit("")).isin(*NO_TEXT), F.lit("")).otherwise(capped(raw, cap))


def count_shown(blocks: Column) -> Column:
    return F.size(F.filter(_list(blocks, BLOCK), has_text)).cast("long")


def _resolved(ref: Column) -> Column:
    return F.size(F.coalesce(ref["fields"], F.array().cast("array<struct<field:string,value:string>>"))) > 0


def _inline(ref: Column) -> Column:
    return F.coalesce(ref["inline"], F.lit(False))


def shown_places(refs: Column) -> Column:
    """Places (from 0) of the references to show: the resolved ones outside the text; if none is outside, the first resolved one."""
    refs = _list(refs, REFERENCE)
    at = lambda keep: F.filter(F.transform(refs, lambda r, i: F.when(keep(r), i)), lambda i: i.isNotNull())
    outside = F.exists(refs, lambda r: ~_inline(r))
    return F.when(outside, at(lambda r: ~_inline(r) & _resolved(r))).otherwise(F.slice(at(_resolved), F.lit(1), F.lit(1)))


def shown_references(refs: Column) -> Column:
    return F.transform(shown_places(refs), lambda i: F.get(refs, i))


def hidden_references(refs: Column) -> Column:
    """The resolved references that are not shown, by their place."""
    rest = F.transform(_list(refs, REFERENCE), lambda r, i: F.when(_resolved(r) & ~F.array_contains(shown_places(refs), i), r))
    return F.filter(rest, lambda r: r.isNotNull())


def main_reference(block: Column) -> Column:
    """The first reference that a block shows; null without one."""
    return F.get(shown_references(block["references"]), 0)


def field_map(fields: Column) -> Column:
    """Fields as a map; of a repeated field the last value."""
    names = F.transform(fields, lambda f: f["field"])
    last = F.filter(F.transform(fields, lambda f, i: F.when(~F.array_contains(F.slice(names, i + 2, F.size(names)), f["field"]), f)), lambda f: f.isNotNull())
    return F.map_from_entries(last)


def reference_key(ref: Column) -> Column:
    """A reference as (work, verse, commentary, page): its fields first, then the names it was written with."""
    value = lambda name: _some(F.get(F.reverse(F.filter(F.coalesce(ref["fields"], F.array().cast("array<struct<field:string,value:string>>")), lambda f: f["field"] == name)), 0)["value"])
    number = lambda *names: F.coalesce(*map(value, names)).try_cast("int")
    return F.struct(F.coalesce(value("work"), _some(ref["work_name"])).alias("work"), number("verse_number", "verse").alias("verse"), F.coalesce(value("commentary"), _some(ref["commentary_name"])).alias("commentary"), number("page_number", "page").alias("page"))


def reference_keys(blocks: Column) -> Column:
    """The different references of blocks in document order; those that say nothing are left out."""
    every = F.flatten(F.transform(_list(blocks, BLOCK), lambda b: F.transform(_list(b["references"], REFERENCE), reference_key)))
    return F.array_distinct(F.filter(every, lambda k: k["work"].isNotNull() | k["verse"].isNotNull() | k["commentary"].isNotNull() | k["page"].isNotNull()))


def extracts(blocks: Column, only: Column | None = None, cap: int = 0) -> Column:
    """(block_index, text, references, main) of the blocks with text, by their place in the whole list; ``only`` one place; the first ``cap``."""
    made = F.transform(_list(blocks, BLOCK), lambda b, i: F.struct(i.alias("block_index"), block_text(b).alias("text"), reference_keys(F.array(b)).alias("references"), main_reference(b).alias("main")))
    kept = F.filter(made, lambda x: (x["text"] != "") & (F.lit(True) if only is None else only.isNull() | (x["block_index"] == only)))
    return F.slice(kept, F.lit(1), F.lit(cap)) if cap else kept


def definitions(sections: Column, cap: int = 0) -> Column:
    """(block_index, text) of the blocks of sections (definitions of blocks); the index counts blocks whose kind has text."""
    blocks = F.flatten(F.transform(F.flatten(F.transform(sections, lambda s: s["definitions"])), lambda d: _list(d["blocks"], BLOCK)))
    kinds = F.filter(blocks, lambda b: ~F.coalesce(b["kind"], F.lit("")).isin(*NO_TEXT))
    made = F.filter(F.transform(kinds, lambda b, i: F.struct(i.alias("block_index"), block_text(b).alias("text"))), lambda x: x["text"] != "")
    return F.slice(made, F.lit(1), F.lit(cap)) if cap else made
