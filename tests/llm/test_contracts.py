"""The registered queries on a small folder of tables: contract columns, repeated rows, nulls, empty tables; methods against brute force."""

import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from textloom.llm import exact, langid, pii, probminhash, quality, registry, sharding, tokenfiles, warc
from textloom.llm.common import scratch

from .test_operators import BASE, BPE, TEXTS, brute_classes, check_pieces, crc, edited, ids_of, prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = {
    "op1_warc_roundtrip": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_language": "doc_id held_out lang_pred score",
    "op3_nnls_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_probminhash": "doc_id class_id class_size kept",
    "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op6_hypergeometric_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op9_sanitisation": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}
#: Rows 5 and 12 are repeated in full; a null id and nulls in all columns occur.
ROWS = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in TEXTS.items()]
ROWS += [ROWS[5], ROWS[12], (None, None, None, None, None)]
PAGES = [(1, "u", "x" * 300), (2, None, "x" * 300), (2, None, "x" * 300), (3, "v", None), (None, "w", "y"), (5, "w", "y")]


def folder(spark, path, rows=ROWS, pages=PAGES):
    spark.createDataFrame(rows, DOCUMENTS).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("tables"))


@pytest.fixture(scope="module")
def results(spark, tables):
    """Rows of every query, once."""
    return {name: f(spark, tables).collect() for name, f in registry.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns_and_rows(results, name):
    rows = results[name]
    assert set(COLUMNS[name].split()) <= set(rows[0].asDict())
    if name == "op3_nnls_packing":
        assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t, *_ in ROWS)
    else:
        key = "page_id" if name.startswith("op1_") else "doc_id"
        assert Counter(r[key] for r in rows) == Counter(r[0] for r in (PAGES if name.startswith("op1_") else ROWS))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_on_empty_tables(spark, tmp_path, name):
    assert registry.QUERIES[name](spark, folder(spark, tmp_path, [], [])).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, tmp_path, name):
    rows = [(i, t, "en", "s", 0) for i, t in TEXTS.items() if "\0" not in (t or "")]
    path = folder(spark, tmp_path, rows, [p for p in PAGES if p[0] is not None][:2] + PAGES[3:4] + PAGES[5:])
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS FROM '{path}/{t}.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, path)
    names = sorted(found.columns)
    assert sorted(map(str, map(tuple, found.select(*names).collect()))) == sorted(map(str, db.sql(registry.SQL[name]).select(*names).fetchall()))


def test_held_out_rule(results):
    for r in results["op2_language"]:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and (r.lang_pred != "und") == bool(re.search(r"[^\W\d_]", dict((a, b) for a, b, *_ in ROWS)[r.doc_id] or ""))


def test_repeated_rows_are_packed_and_listed_twice(results):
    pieces = [r for r in results["op3_nnls_packing"] if r.doc_id == 12]
    assert Counter((r.start, r.length, r.ids_crc32) for r in pieces).most_common()[0][1] == 2 or len(pieces) > 2
    base = {r.doc_id: r for r in results["op9_sanitisation"]}
    assert (base[12].n_email, base[12].n_ip, base[12].n_card, base[12].n_phone) == (1, 1, 1, 1)
    assert base[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    slots = defaultdict(list)
    for r in results["op6_hypergeometric_shards"]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min([len(slots[k]) for k in range(40)]) <= 1
    starts = sorted((r.start, r.n_tokens) for r in results["op8_token_files"])
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_every_language_can_be_learned(spark):
    r = random.Random(3)
    alphabet = [chr(0x4E00 + 7 * k) for k in range(2000)]
    rows = [(1000 * k + j, " ".join("".join(r.choice(alphabet[8 * k : 8 * k + 8]) for _ in range(5)) for _ in range(20)), f"l{k:03}") for k in range(230) for j in range(3) if zlib.crc32(str(1000 * k + j).encode()) % 5]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.training_sample(table).select("lang").distinct().count() == len({x[2] for x in rows}) > 220
    assert langid.training_sample(table, rows=20).count() >= 220


def test_very_long_text_is_one_row(spark):
    long = " ".join(["the thing there"] * 200_000)
    rows = [(k, f"the er thing ou {prose(30, k)}" if k % 2 else f"sch ung ß {prose(30, k)}", "en" if k % 2 else "de") for k in range(40)] + [(99, long, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.predict(table, langid.train(table)).filter("doc_id = 99").first().lang_pred in ("en", "de")


def record(fields, block, sep=": "):
    head = "WARC/1.0\r\n" + "".join(f"{k}{sep}{v}\r\n" for k, v in fields) + f"Content-Length{sep}{len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def test_archives_of_other_writers():
    import base64

    body = b"<html>x</html>"
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + body
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    data = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n")
    data += record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.0\r\n\r\n", ":")
    data += record([("warc-type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("Content-Type", "application/http;\r\n\tmsgtype=response"), ("WARC-Block-Digest", sha1(http)), ("WARC-Payload-Digest", sha1(body))], http)
    data += record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:uuid:4>"), ("WARC-Block-Digest", "blake3:00"), ("WARC-Payload-Digest", "md5:" + hashlib.md5(body).hexdigest())], body)
    data += record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:5>"), ("WARC-Refers-To", "<urn:uuid:3>"), ("WARC-Payload-Digest", sha1(body))], b"")
    rows = [warc.parsed(*r) for r in warc.read_members(io.BytesIO(data))]
    assert [(r[2], r[6], r[7]) for r in rows] == [("warcinfo", b"software: x\r\n", "<urn:uuid:1>"), ("request", b"", "<urn:uuid:2>"), ("response", body, "<urn:uuid:3>"), ("resource", body, "<urn:uuid:4>"), ("revisit", None, "<urn:uuid:5>")]
    assert rows[2][5] == rows[4][5] == hashlib.sha1(body).hexdigest() and rows[4][8] == "<urn:uuid:3>" and rows[4][4] is None
    bad = record([("WARC-Type", "resource"), ("WARC-Payload-Digest", sha1(b"other"))], body)
    with pytest.raises(warc.WarcError):
        warc.parsed(*next(warc.read_members(io.BytesIO(bad))))


def test_rows_with_equal_ids(spark):
    one, two = prose(80, 901), prose(80, 902)
    table = spark.createDataFrame([(3, one, 1), (5, one, 2), (5, two, 3)], "doc_id long, text string, own_x int")
    found = sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in probminhash.near_duplicates(table).collect())
    assert found == [(3, 3, 2, True), (5, 3, 2, False), (5, 5, 1, True)]
    assert sorted(r.own_x for r in probminhash.drop_near_duplicates(table).collect()) == [1, 3]
    spaced = spark.createDataFrame([(5, "a b c"), (5, "a  b  c  "), (7, "other"), (7, "other"), (None, "abc"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in exact.drop_exact_duplicates(spaced).collect()) == [(0, ""), (5, "a  b  c  "), (7, "other")]
    whole = spark.createDataFrame([(1, one), (1, one), (2, one)], "doc_id long, text string")
    assert [r.doc_id for r in probminhash.drop_near_duplicates(whole).collect()] == [1]


def test_near_duplicates_among_groups_with_shared_passages(spark):
    shared = prose(200, 5000)
    texts = {k: f"{shared} {prose(200, 6000 + k // 4)}" if k % 4 == 0 else edited(f"{shared} {prose(200, 6000 + k // 4)}", random.Random(k).sample(range(400), 1 + k % 5)) for k in range(120)}
    found = {r.doc_id: r.class_id for r in probminhash.near_duplicates(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")).collect()}
    assert found == brute_classes(texts)


def brute_terms(texts):
    """Disclosing terms by plain counting over the different texts."""
    texts = sorted(set(texts))
    has = Counter(w for t in texts for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())))
    c, n_e = defaultdict(set), defaultdict(set)
    for k, t in enumerate(texts):
        for m in re.finditer(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", t):
            n_e[m[0]].add(k)
            left, right = t[max(0, m.start() - 81) : m.start()], t[m.end() : m.end() + 81]
            left = re.sub(r"\A(?:[^\W\d_]+|.)", "", left, flags=re.S) if len(left) > 80 else left
            right = re.sub(r"(?:(?<![^\W\d_])[^\W\d_]+|.)\Z", "", right, flags=re.S) if len(right) > 80 else right
            for w in set(re.findall(r"[^\W\d_]{3,}", f"{left} {right}".lower())):
                c[m[0], w].add(k)
    out, n = set(), len(texts)
    for (e, w), k in c.items():
        if len(k) >= 3 and len(n_e[e]) < n:
            share = math.log(n * len(k) / (has[w] * len(n_e[e]))) / math.log(n / len(n_e[e]))
            if share >= 0.9 - 1e-9:
                out.add(w)
    return out


def test_disclosing_terms_by_brute_force(spark):
    r = random.Random(8)
    names = ["zanzi", "quillo", "brandt", "osmund", "petrel", "the"]
    texts = []
    for k in range(400):
        t = prose(60, 20_000 + k).split(" ")
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t))
            who = r.randrange(6)
            t[at:at] = [names[who] if r.random() < 0.9 else r.choice(names), "writes", f"{'abcdef'[who]}.x@mail.example", "so" if k % 3 else names[who]]
        texts.append(" ".join(t))
    texts += texts[:40]
    rows = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {s.value.lower() for x in rows for s in x.term}
    assert found == brute_terms(texts) and found


def test_very_long_text_with_disclosing_terms(spark):
    filler = " ".join(prose(1, k % 5000) + "x" * (k % 3) for k in range(200_000))
    long = f"{filler} Zanzibarian office a.b@example.org {filler} Zanzibarian é 😀 c.d@example.org tail"
    texts = {k: f"{prose(40, k)} Zanzibarian office a.b@example.org {prose(40, k + 1000)}" for k in range(4)} | {50: long} | {100 + k: prose(80, k + 5000) for k in range(300)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    row = pii.spans(table).filter("doc_id = 50").first()
    assert [long[s.start : s.end] for s in row.term if s.value == "Zanzibarian"] == ["Zanzibarian"] * 2 and [long[s.start : s.end] for s in row.email] == ["a.b@example.org", "c.d@example.org"]
    clean = pii.sanitised(table).filter("doc_id = 50").first().text
    assert clean.endswith("[NAME] é 😀 [EMAIL] tail") and "example" not in clean and clean.startswith(filler)


def test_many_spans_are_replaced_once(spark):
    text = " ".join(f"u{k}@mail.example é +49 170 {1000000 + k} 10.0.{k % 256}.1" for k in range(3000))
    clean = pii.sanitised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == " ".join(["[EMAIL] é [PHONE] [IP]"] * 3000) or clean.count("[EMAIL]") == 3000


def test_kept_by_exact_quantiles(spark):
    r = random.Random(4)
    rows = []
    for k in range(300):
        words = prose(80, k).split(" ")
        for _ in range(r.choice([0, 0, 0, 1, 2, 30])):
            words[r.randrange(80)] += "###"
        rows.append((k, " ".join(words), "en" if k % 2 else None, f"s{k % 3}"))
    found = quality.judged(quality.measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()
    cells = defaultdict(list)
    for x in found:
        cells[x.lang, x.source].append(x)
    for own in cells.values():
        inside = {x.doc_id: not x.base_failed for x in own}
        for m, least in quality.MEASURES.items():
            v = sorted(x[m] for x in own)
            low, high = (v[max(0, math.ceil(p * len(v)) - 1)] for p in (0.25, 0.75))
            reach = quality.FENCE * max(high - low, least)
            for x in own:
                inside[x.doc_id] &= x[m] <= high + reach and (m != "word_length" or x[m] >= low - reach)
        assert {x.doc_id: x.kept for x in own} == inside
    assert 0 < sum(x.kept for x in found) < 300


def test_cells_that_are_not_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([(k, prose(60, k), f"l{k % 3}" if k % 4 else None, None) for k in range(60)], "doc_id long, text string, lang string, source string")
    one = quality.judged(quality.measures(table)).collect()
    monkeypatch.setattr(quality, "BROADCAST_CELLS", 0)
    assert sorted(map(str, quality.judged(quality.measures(table)).select(*one[0].asDict()).collect())) == sorted(map(str, one))


def test_shards_are_uniform(spark):
    table = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    counts = np.zeros((2, 4))
    for seed in range(6):
        for r in sharding.shard(table, 4, seed, 8).collect():
            counts[int(r.doc_id < 2000), r.shard] += 1
            counts[int(r.doc_id < 2000), r.shard] += 0
    assert abs(counts / 6 - 500).max() < 4 * (500 * 0.75 * 0.5 / 6) ** 0.5


def test_large_draws_are_hypergeometric():
    rng = np.random.default_rng(9)
    x = np.array([sharding.drawn(rng, 15 * 10**8, 15 * 10**8, 15 * 10**8) for _ in range(400)], float)
    var = 15e8 * 0.25 * 15e8 / (3e9 - 1)
    assert abs(x.mean() - 75e7) < 5 * (var / 400) ** 0.5 and 0.75 < x.var() / var < 1.3


def test_range_of_token_files(spark, tmp_path):
    texts = {k: prose(5 + k % 7, k) for k in range(2000)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    manifest = tokenfiles.write_tokens(table, scratch(spark, "test"), BPE, parts=2)
    whole = {r.doc_id: r for r in tokenfiles.read_tokens(manifest, ("doc_id", "start", "n_tokens", "ids_crc32", "ids")).collect()}
    part = tokenfiles.read_range(manifest, 900, 1100, ("doc_id", "start", "n_tokens", "ids_crc32", "ids")).collect()
    assert sorted(r.doc_id for r in part) == list(range(900, 1101)) and all(r == whole[r.doc_id] for r in part)
    assert all(r.ids == ids_of(texts[r.doc_id]) and r.ids_crc32 == crc(r.ids) for r in part)
    assert tokenfiles.read_range(manifest, 5000, 6000).count() == 0


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "a", [])).count() == 0
    rows = [(1, BASE, None, None, 1), (1, BASE, None, None, 1), (None, BASE, "en", "s", 1), (2, BASE + " x", "en", "s", 1), (3, prose(300, 77), "en", "s", 1), (None, None, None, None, None)]
    found = corpus_pipeline.run(spark, folder(spark, tmp_path / "b", rows)).collect()
    assert {r.doc_id for r in found} == {1, 3} and not json.dumps([r.length for r in found]) == "[]"
    check_pieces(found, {1: BASE, 3: prose(300, 77)})
