"""All registered queries and their SQL."""

from __future__ import annotations

from textloom.plans import base, ingest, maintenance, matching, navigation, queries, retrieval, search, verses

QUERIES = base.QUERIES
SQL = base.SQL
FLAGSHIP = queries.FLAGSHIP
MODULES = (queries, retrieval, navigation, search, verses, matching, maintenance, ingest)
