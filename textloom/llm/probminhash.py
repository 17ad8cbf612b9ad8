"""Near-duplicate classes with ProbMinHash signatures, banding and exact verification.

Texts with the same words are first reduced to one representative. Its shingles (five words) send exponential arrivals
to random registers; a shingle stops once its arrival time exceeds all registers, and a register holds the shingle of its
earliest arrival, so two registers agree with the probability Jaccard similarity. All distinct shingles have the weight 1,
however often they occur: then this is the Jaccard similarity of the sets, by which links are defined.
Bands of registers give buckets; links are pairs whose sets of shingles have an exact Jaccard similarity of at least
``similarity``; classes are the connected components of the links.

A bucket's members are first compared with its least member. Buckets whose members then still belong to more than one
class go on: all pairs of members of different classes are compared, so that no link of a bucket is lost, while buckets of
copies of one text, however many, cost one comparison a member. Before that, the texts of such buckets are dealt anew into
buckets of a second, finer level (more registers, longer bands), which sets apart texts that only share a passage, and of
those pairs only such are compared as share one of their rarest shingles, which similar texts always do.

Hot groups: whatever is joined on a bucket, a leader, a class, a node of the component search or a sequence of words is
first grouped by that key and a salt, so that a key of any size is dealt out to SALTS tasks.

Defined results: texts that are null or without words have no shingles and are classes of their own; texts of one to
four words have one shingle of all their words; rows with equal ids but different texts are told apart by their texts; of
a class the row with the least doc_id stays, of several with that id the one whose text has the least hash (fully repeated
rows all count as kept, and drop_near_duplicates leaves one of them); class_id is the id of the row that stays; null
ids are classes of their own; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import salted_groups, stored
from textloom.llm.shingles import mix, shingle_sets, text_chunks, word_hashes
from textloom.llm.tok import forget

#: Registers and rows of a band. At a Jaccard similarity of 0.8 a pair shares no bucket of the first level in 1 of 20
#: million cases, and none of the second, which only texts of mixed buckets reach, in 1 of 100,000.
LEVELS = ((128, 4), (512, 8))
SIMILARITY = 0.8
SALTS = 16
#: Rounds of the component search between the levels.
ROUNDS = 2
#: Rows that do not stay, up to which they are broadcast (24 bytes each).
BROADCAST_GONE = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """Registers of each weighted set (distinct keys, counts); all sets must have a key."""
    n = np.array([len(k) for k, _ in sets])
    of = np.repeat(np.arange(len(sets)), n)
    key = np.concatenate([k for k, _ in sets])
    weight = 1 + np.log2(np.concatenate([c for _, c in sets]))
    time = np.zeros(len(key))
    first = np.full(len(sets) * registers, np.inf)
    holder = np.zeros(len(sets) * registers, np.uint64)
    draw = key.copy()
    bits = np.uint64(64 - (registers.bit_length() - 1))
    while len(key):
        draw += _STEP
        u = mix(draw)
        time += -np.log1p(-(u >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight
        at = of * registers + (mix(u ^ _STEP) >> bits).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        holder[at[won]] = key[won]
        last = first.reshape(-1, registers).max(axis=1)
        live = time < last[of]
        if not live.all():
            of, key, weight, time, draw = of[live], key[live], weight[live], time[live], draw[live]
    return holder.reshape(-1, registers)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature; keys of different bands differ."""
    bands = signature.shape[1] // rows
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0x100000001B3) + parts[:, :, k])
    return out


def word_digest(docs: DataFrame) -> DataFrame:
    """doc_id, own (a hash of the text) and two 64-bit hashes of the sequence of words (null without words)."""
    names = ["doc_id", "own", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            one, two = [], []
            for _, _, data, cuts in text_chunks(b.column(1)):
                words, first = word_hashes(data, cuts)
                place = mix((np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64) + _STEP)
                sums = [np.concatenate([[0], np.cumsum(x, dtype=np.uint64)]).astype(np.uint64) for x in (mix(words ^ place), mix(words * (place | np.uint64(1))))]
                some = np.diff(first) > 0
                for out, s in zip((one, two), sums, strict=True):
                    out.append(pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64), mask=~some))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.concat_arrays(one), pa.concat_arrays(two)], names=names)

    return docs.select("doc_id", "text", _own(F.col("text"))).mapInArrow(run, "doc_id long, own long, d1 long, d2 long")


def _own(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("own")


def _salt(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")


def banded(texts: DataFrame, registers: int, rows: int) -> DataFrame:
    """(bucket, id, n) for each band of each text (id, text) of n distinct shingles; repeats do not count, as in ``verified``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, cuts in text_chunks(b.column(1)):
                sets = [(s, np.ones(len(s), np.int64)) for s, _ in shingle_sets(data, cuts)]
                some = [k for k, (s, _) in enumerate(sets) if len(s)]
                if some:
                    keys = band_keys(signatures([sets[k] for k in some], registers), rows)
                    own = np.repeat(ids[i:j][some], keys.shape[1])
                    size = np.repeat([len(sets[k][0]) for k in some], keys.shape[1]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(own.astype(np.int64)), pa.array(size)], names=["bucket", "id", "n"])

    return texts.select("id", "text").mapInArrow(run, "bucket long, id long, n int")


def shingled(texts: DataFrame) -> DataFrame:
    """(id, shingles): the distinct shingle hashes of each text (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for i, j, data, cuts in text_chunks(b.column(1)):
                sets = [s for s, _ in shingle_sets(data, cuts)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def _alike(n: str, m: str, similarity: float) -> Column:
    """Whether sets of n and m elements can have the similarity."""
    return (F.col(n) >= similarity * F.col(m)) & (F.col(m) >= similarity * F.col(n))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets (id, shingles) have at least the similarity; pairs of unlike sizes should be left out before.

    The set of a frequent b is fetched once for each salt of its pairs, of which it has SALTS at most.
    """
    dealt = pairs.select("a", "b", _salt("a").alias("salt"))
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    two = dealt.select("b", "salt").distinct().join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b")
    both = dealt.join(one, "a").join(two, ["b", "salt"])
    common = F.size(F.array_intersect("s", "t"))
    return both.withColumn("common", common).filter(F.col("common") >= similarity * (F.size("s") + F.size("t") - F.col("common"))).select("a", "b")


def _with_least(rows: DataFrame) -> DataFrame:
    """The rows (u, v) with m, the least v or u of all rows of their u; one shuffle serves the groups and the rows."""
    dealt = rows.withColumn("salt", _salt("v")).repartition("u", "salt")
    least = salted_groups(dealt, "u", F.col("v"), [F.min("v").alias("low")], [F.least(F.min("low"), F.col("u")).alias("m")], SALTS)
    return dealt.join(least, ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, class) of every end of the links (a, b), class the least id of its component.

    Each round hands every node's least neighbour to its larger neighbours, then to its smaller ones, until nothing
    changes; rounds grow with the logarithm of the longest chain. Only sums leave the executors. After a given number of rounds
    ends of one class are surely of one component, but a component may still have several classes.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen, done = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Here v < u, so that m is the least v; a node is linked to it, and so are its other neighbours.
        small = _with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        edges = stored(small, "links")
        done += 1
        if done == rounds:
            edges = edges.groupBy("u").agg(F.min("v").alias("v"))
            break
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    tops = edges.select(F.col("v").alias("id")).distinct()
    if rounds:
        tops = tops.join(edges.select(F.col("u").alias("id")), "id", "left_anti")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(tops.select("id", F.col("id").alias("class")))


def shared_buckets(texts: DataFrame, registers: int, rows: int) -> DataFrame:
    """(bucket, salt, id, n, leader, m) of the buckets with two members and more, leader the least, of m shingles; hot buckets are salted."""
    members = stored(banded(texts, registers, rows).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), "bands")
    shared = salted_groups(members, "bucket", F.col("id"), [F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("high")], [F.min("low").alias("leader"), F.max("high").alias("high")], SALTS).filter("leader.id < high")
    return stored(members.join(shared.select("bucket", "salt", F.col("leader.id").alias("leader"), F.col("leader.n").alias("m")), ["bucket", "salt"]).select("bucket", "salt", "id", "n", "leader", "m"), "buckets")


def rare_prefixes(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(token, id, class, n, rest): the rarest shingles of each set (id, shingles, class), of which similar sets share one.

    Sets of a similarity of at least s share one of the first n - ceil(s * n) + 1 shingles of each in any common order;
    here that is by the number of sets that have the shingle. Shingles of one set alone need not be listed. ``rest``
    counts the shingles from this one on: of the first common shingle of similar sets, both have enough left.
    """
    sets = sets.withColumn("n", F.size("shingles"))
    tokens = sets.select("id", "class", "n", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    lists = tokens.join(often, "token").groupBy("id").agg(F.first("class").alias("class"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("list"))
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("list"))
    lists = lists.withColumn("length", length.cast("int")).filter("length > 0")
    listed = lists.select(F.posexplode(F.slice("list", F.lit(1), F.col("length"))).alias("at", "x"), "id", "class", "n", (F.col("n") - F.size("list")).alias("alone"))
    return listed.select("x.token", "id", "class", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))


def near_classes(texts: DataFrame, similarity: float = SIMILARITY, levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """(id, class) of the texts (id, text; ids differ) that have a link.

    Between the levels ROUNDS rounds of the component search tell which buckets are mixed: classes that are not joined yet only
    make more of them so.
    """
    pool, sets, links, compared = texts, None, None, None
    for registers, rows in levels:
        members = shared_buckets(pool, registers, rows)
        if sets is None:
            sets = stored(shingled(texts.join(members.select("id").distinct(), "id", "left_semi")), "shingles")
        pairs = members.filter("id <> leader").filter(_alike("n", "m", similarity)).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
        pairs = stored(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        found = stored(verified(pairs, sets, similarity), "links")
        compared = pairs if compared is None else compared.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        classes = components(links, ROUNDS)
        placed = members.join(classes, "id", "left").select("bucket", "salt", "id", F.coalesce("class", "id").alias("class"))
        mixed = salted_groups(placed, "bucket", F.col("id"), [F.min("class").alias("x"), F.max("class").alias("y")], [F.min("x").alias("x"), F.max("y").alias("y")], SALTS).filter("x < y").select("bucket", "salt")
        placed = stored(placed.join(mixed, ["bucket", "salt"], "left_semi"), "mixed")
        if placed.isEmpty():
            return components(links)
        pool = texts.join(placed.select("id").distinct(), "id", "left_semi")
    own = placed.groupBy("id").agg(F.first("class").alias("class"))
    prefixes = rare_prefixes(sets.join(own, "id"), similarity).withColumn("salt", _salt("id"))
    prefixes = stored(prefixes, "prefixes")
    # Only tokens of more than one class can give a pair.
    mixed = salted_groups(prefixes, "token", F.col("id"), [F.min("class").alias("x"), F.max("class").alias("y")], [F.min("x").alias("x"), F.max("y").alias("y")], SALTS).filter("x < y").select("token", "salt")
    prefixes = stored(prefixes.join(mixed, ["token", "salt"], "left_semi"), "prefixes")
    other = prefixes.select("token", F.col("id").alias("b"), F.col("class").alias("other"), F.col("n").alias("m"), F.col("rest").alias("left"))
    needed = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-6
    more = prefixes.join(other, "token").filter((F.col("id") > F.col("b")) & (F.col("class") != F.col("other")) & (F.least("rest", "left", "n", "m") >= needed))
    more = more.select(F.col("id").alias("a"), "b").distinct().join(compared, ["a", "b"], "left_anti")
    return components(links.unionByName(verified(stored(more, "pairs"), sets, similarity)))


def _placed(docs: DataFrame, similarity: float, levels: tuple[tuple[int, int], ...]) -> DataFrame:
    """doc_id, own (a hash of the text), head (the doc_id and own of the row that stays) and class_size of every row; head is null where a row is a class of its own."""
    docs = docs.select("doc_id", "text")
    digests = stored(word_digest(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id", "own"), F.lit(SALTS)).cast("int")), "digests")
    worded = digests.filter("doc_id IS NOT NULL AND d1 IS NOT NULL").withColumn("key", F.struct("d1", "d2"))
    # One row for each sequence of words, with a number of its own: the nodes of the component search.
    parts = worded.groupBy("key", "salt").agg(F.min(F.struct("doc_id", "own")).alias("low"), F.count(F.lit(1)).alias("n"))
    nodes = parts.groupBy("key").agg(F.collect_set("salt").alias("salts"), F.min("low").alias("first"), F.sum("n").alias("n"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "representatives")
    texts = docs.withColumn("own", _own(F.col("text"))).join(nodes.select("first.doc_id", "first.own", "id"), ["doc_id", "own"]).select("id", "text")
    if not worded.groupBy("doc_id", "own").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["id"])
    classes = near_classes(texts, similarity, levels)
    linked = nodes.select("id", "key", "first", "n").join(classes, "id").withColumn("salt", _salt("id"))
    heads = salted_groups(linked, "class", F.col("id"), [F.min("first").alias("low"), F.sum("n").alias("size")], [F.min("low").alias("head"), F.sum("size").alias("class_size")], SALTS)
    linked = linked.join(heads, ["class", "salt"]).select("id", "head", "class_size")
    every = nodes.join(linked, "id", "left").select("key", F.explode("salts").alias("salt"), F.coalesce("head", "first").alias("head"), F.coalesce("class_size", "n").alias("class_size"))
    found = worded.join(every, ["key", "salt"]).select("doc_id", "own", "head", "class_size")
    alone = digests.filter("doc_id IS NULL OR d1 IS NULL").select("doc_id", "own", F.lit(None).cast("struct<doc_id:bigint,own:bigint>").alias("head"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone)


def _kept() -> Column:
    return F.col("head").isNull() | (F.col("head") == F.struct("doc_id", "own"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """doc_id, class_id (the doc_id that stays), class_size and kept for every document (doc_id, text)."""
    return _placed(docs, similarity, levels).select("doc_id", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), "class_size", _kept().alias("kept"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, with one row of each near-duplicate class.

    Only (doc_id, own) of the rows that go are joined to the texts, broadcast if they are few enough; fully repeated rows are
    reduced to one if there are any.
    """
    found = stored(_placed(docs, similarity, LEVELS).select("doc_id", "own", _kept().alias("kept")), "verdicts")
    gone = stored(found.filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("own").alias("gone_own")).distinct(), "gone")
    small = F.broadcast if gone.count() <= BROADCAST_GONE else (lambda x: x)
    rows = docs.withColumn("own_", _own(F.col("text")))
    rows = rows.join(small(gone), (F.col("doc_id") == F.col("gone_id")) & (F.col("own_") == F.col("gone_own")), "left_anti")
    if not found.filter("kept").groupBy("doc_id", "own").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "own_"])
    return rows.select(*docs.columns)
