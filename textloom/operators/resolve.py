"""Tokens to terms, phrases to topics, and the retrieval that is composed of both.

Tokens are a stated set of at most MOST_TOKENS; they are broadcast and compared with all terms. Limits that a caller may
not pass are errors, not cuts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import graph

MOST_TOKENS, MOST_SUGGESTIONS = 32, 20
LEAF_FACTOR, CONTAINER_FACTOR = 1.0, 0.6


def nfc(df: DataFrame, *columns: str) -> DataFrame:
    """The table with the columns in Unicode's normal form C, for use once, when data comes in; normal texts are not rebuilt."""

    def normal(column: pa.Array) -> pa.Array:
        if not pc.any(pc.invert(pc.string_is_ascii(column))).as_py():
            return column
        return pa.array([t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in column.to_pylist()], column.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([normal(b.column(c)) if c in columns else b.column(c) for c in b.schema.names], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def normal_token(token: str) -> str:
    """A token in normal form C without zero-width joiners, trimmed."""
    return unicodedata.normalize("NFC", token).replace("‌", "").replace("‍", "").strip()


def token_rows(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """(pos, token, norm) of the tokens, once each, in order of their first place; an error beyond MOST_TOKENS or without any."""
    if not 0 < len(tokens) <= MOST_TOKENS:
        raise ValueError(f"{len(tokens)} tokens; 1 to {MOST_TOKENS} are taken")
    return spark.createDataFrame([(k, t, normal_token(t)) for k, t in enumerate(dict.fromkeys(tokens))], "pos int, token string, norm string")


def _lookup(forms: DataFrame, terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(pos, prio, found): the term of a form, else the least term that has it as an alias; by step, the exact one first."""
    exact = terms.select(F.col("term").alias("form")).join(F.broadcast(forms), "form").select("pos", (F.col("step") * 2).alias("prio"), F.col("form").alias("found"))
    alias = aliases.select(F.col("alias").alias("form"), "term").join(F.broadcast(forms), "form").groupBy("pos", "step").agg(F.min("term").alias("found")).select("pos", (F.col("step") * 2 + 1).alias("prio"), "found")
    return exact.unionByName(alias)


def matched(tokens: DataFrame, terms: DataFrame, aliases: DataFrame, strip: Column) -> DataFrame:
    """(pos, kind, term) of the tokens (pos, norm) that name a term (term) or an alias (alias, term), as they are or stripped.

    Kinds: exact, alias, and suffix_strip for either after stripping. Tokens with the same stem are all matched.
    """
    forms = tokens.select("pos", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("norm").alias("form")), F.struct(F.lit(1).alias("step"), strip.alias("form")))).alias("x")).select("pos", "x.*").filter("form IS NOT NULL")
    best = _lookup(forms, terms, aliases).groupBy("pos").agg(F.min(F.struct("prio", "found")).alias("b"))
    kind = F.when(F.col("b.prio") == 0, "exact").when(F.col("b.prio") == 1, "alias").otherwise("suffix_strip")
    return best.select("pos", kind.alias("kind"), F.col("b.found").alias("term"))


def suggestions(tokens: DataFrame, terms: DataFrame, aliases: DataFrame, top_k: int = 5, least: float = 0.35) -> DataFrame:
    """(pos, place, term, similarity): the top_k most similar names of terms, their own and their aliases, for each token."""
    if not 1 <= top_k <= MOST_SUGGESTIONS:
        raise ValueError(f"top_k is 1 to {MOST_SUGGESTIONS}")
    names = terms.select("term", F.col("term").alias("name")).unionByName(aliases.select("term", F.col("alias").alias("name")))
    asked = tokens.select("pos", T.trigrams(F.col("norm")).alias("grams"))
    near = names.withColumn("own", T.trigrams(F.col("name"))).join(F.broadcast(asked), F.arrays_overlap("own", "grams"))
    near = near.withColumn("similarity", T.jaccard(F.col("own"), F.col("grams"))).filter(F.col("similarity") >= least)
    place = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("similarity"), "term", "name"))
    return near.select("pos", "term", "name", "similarity").withColumn("place", place).filter(F.col("place") <= top_k).drop("name")


def resolve_tokens(tokens: DataFrame, terms: DataFrame, aliases: DataFrame, top_k: int = 5, least: float = 0.35) -> DataFrame:
    """(pos, token, kind, term, suggestions) of every token; kind is none, with suggestions, where nothing matches."""
    found = matched(tokens, terms, aliases, T.strip_suffix(F.col("norm")))
    near = suggestions(tokens.join(found, "pos", "left_anti"), terms, aliases, top_k, least)
    lists = near.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "term", "similarity"))), lambda x: F.struct(x["term"].alias("term"), x["similarity"].alias("similarity"))).alias("suggestions"))
    out = tokens.join(found, "pos", "left").join(lists, "pos", "left")
    none = F.array().cast("array<struct<term:string,similarity:double>>")
    return out.select("pos", "token", F.coalesce("kind", F.lit("none")).alias("kind"), "term", F.coalesce("suggestions", none).alias("suggestions"))


def resolve_each(tokens: DataFrame, terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(pos, token, kind, term): as resolve_tokens, but one mark at the end of a token is stripped, and nothing is suggested."""
    found = matched(tokens, terms, aliases, T.strip_end_mark(F.col("norm")))
    return tokens.join(found, "pos", "left").select("pos", "token", F.coalesce("kind", F.lit("none")).alias("kind"), "term")


def resolve_by_alias_edges(tokens: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, token, term) for each term node that a token names itself or by an alias node's ALIAS_OF edge."""
    own = nodes.filter("label = 'keyword'").select(F.col("nk").alias("norm"), F.col("nk").alias("term"))
    alias = edges.filter("type = 'ALIAS_OF'").select(F.col("src").alias("norm"), F.col("dst").alias("term"))
    return own.unionByName(alias).join(F.broadcast(tokens), "norm").select("pos", "token", "term").distinct()


def topics_match(topics: DataFrame, phrase: str, tokens: list[str] | None = None, limit: int = 5, least: float = 0.30, leaf_only: bool = False, content_only: bool = True, least_coverage: float = 0.5) -> DataFrame:
    """Topics (nk, display, is_leaf, content) like a phrase, ranked: nk, similarity, coverage, score.

    The similarity is that of key and phrase, or 1 if what is displayed contains the phrase; at least ``least_coverage`` of the
    phrase's tokens must begin a part of the key. Topics without content go before the limit, if content_only.
    """
    if not phrase.strip() or not 1 <= limit <= 50:
        raise ValueError("a phrase and a limit of 1 to 50")
    given = F.array(*[F.lit(t) for t in (tokens or phrase.split())])
    rows = topics.filter("is_leaf") if leaf_only else topics
    rows = rows.filter("content > 0") if content_only else rows
    similar = T.trigram_similarity(F.replace("nk", F.lit("/"), F.lit(" ")), F.lit(phrase))
    rows = rows.withColumn("raw", F.greatest(similar, F.when(T.literal_like(F.col("display"), phrase), 1.0).otherwise(0.0)))
    rows = rows.filter(F.col("raw") >= least).withColumn("coverage", T.covered(T.segments(F.col("nk")), T.coverage_tokens(given))).filter(F.col("coverage") >= least_coverage)
    factor = F.when(F.coalesce("is_leaf", F.lit(False)), LEAF_FACTOR).otherwise(CONTAINER_FACTOR)
    rows = rows.withColumn("similarity", F.round(F.col("raw") * F.col("coverage"), 6)).withColumn("score", F.round(F.col("raw") * F.col("coverage") * factor, 6))
    return rows.orderBy(F.desc("score"), "nk").limit(limit)


def graphrag(tokens: DataFrame, terms: DataFrame, aliases: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 2, limit: int = 10, fuzzy: bool = False, types: tuple[str, ...] | None = None) -> DataFrame:
    """Topics near the terms that the tokens name, ranked: topic, overlap, weight, score, is_leaf.

    With ``fuzzy`` the first suggestion stands for a token that names nothing. nodes (nk, label, is_leaf).
    """
    found = resolve_tokens(tokens, terms, aliases)
    seed = F.coalesce("term", F.get("suggestions", 0)["term"]) if fuzzy else F.col("term")
    seeds = found.select(seed.alias("nk")).filter("nk IS NOT NULL").distinct()
    topics = nodes.filter("label = 'topic'").select("nk", "is_leaf")
    hits = graph.trail_sums(F.broadcast(seeds), edges, topics, max_hops, types)
    return graph.rank(hits, topics).orderBy(F.desc("score"), F.desc("overlap"), F.desc("weight"), "topic").limit(limit)
