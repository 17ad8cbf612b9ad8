"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from textloom.llm.exact import OP5_SQL, op5_exact_dedup
from textloom.llm.langid import op2_language
from textloom.llm.packing import op3_nnls_packing
from textloom.llm.pii import op9_sanitisation
from textloom.llm.piece import op7_sentencepiece
from textloom.llm.probminhash import op4_probminhash
from textloom.llm.quality import op10_quality
from textloom.llm.sharding import op6_hypergeometric_shards
from textloom.llm.tokenfiles import op8_token_files
from textloom.llm.warc import OP1_SQL, op1_warc_roundtrip

QUERIES = {f.__name__: f for f in (op1_warc_roundtrip, op2_language, op3_nnls_packing, op4_probminhash, op5_exact_dedup, op6_hypergeometric_shards, op7_sentencepiece, op8_token_files, op9_sanitisation, op10_quality)}
SQL = {"op1_warc_roundtrip": OP1_SQL, "op5_exact_dedup": OP5_SQL}
