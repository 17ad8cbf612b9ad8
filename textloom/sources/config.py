"""Tables of configuration: the registry of works, from JSON (or YAML where its library is there), checked when it is read."""

from __future__ import annotations

import json
import posixpath
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Keys of an entry and their kinds; an entry with another key, or with a value of another kind, is an error.
ENTRY = {"name": str, "alternates": list, "short": str, "formats": list, "commentary_of": str, "publisher": str, "verse_fields": list, "interlude_fields": list, "page_offsets": list, "file": str}
SCHEMA = "name string, alternates array<string>, short string, formats array<string>, commentary_of string, publisher string, verse_fields array<string>, interlude_fields array<string>, page_offsets array<struct<up_to:int,offset:int>>, file string"


def parsed(text: str, kind: str = "json") -> Any:
    if kind == "json":
        return json.loads(text)
    import yaml  # only where it is installed

    return yaml.safe_load(text)


def checked(entries: Any) -> list[dict]:
    """The entries with all keys, missing ones null; an error names the entry that breaks the schema."""
    if not isinstance(entries, list):
        raise ValueError("a registry is a list of entries")
    out, seen = [], set()
    for k, e in enumerate(entries):
        if not isinstance(e, dict) or not e.get("name"):
            raise ValueError(f"entry {k} has no name")
        for key, value in e.items():
            if key not in ENTRY or not isinstance(value, (ENTRY[key], type(None))):
                raise ValueError(f"entry {e['name']!r}: {key}")
        if e["name"] in seen:
            raise ValueError(f"entry {e['name']!r} is there twice")
        seen.add(e["name"])
        out.append({key: e.get(key) for key in ENTRY})
    for e in out:
        if e["commentary_of"] and e["commentary_of"] not in seen:
            raise ValueError(f"entry {e['name']!r} comments on an unknown work")
        e["page_offsets"] = [{"up_to": int(a), "offset": int(b)} for a, b in e["page_offsets"] or []]
    return out


def read_registry(spark: SparkSession, path: str) -> list[dict]:
    """The registry in a file that Spark can read."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return checked(parsed(text, "yaml" if path.endswith((".yaml", ".yml")) else "json"))


def registry_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(e[c] for c in ENTRY) for e in entries], SCHEMA)


def safe_path(root: str, file: str) -> str:
    """The path of a file under root; one that leads out of it is an error."""
    path = posixpath.normpath(posixpath.join(root, file))
    if not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{file} is not under {root}")
    return path
