"""Each operator against brute force on a fixture with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import exact, langid, packing, pii, piece, probminhash, quality, sharding, tok, tokenfiles, warc
from textloom.llm.common import scratch

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, digest string, id long, class string, key string, salt int, t string, n long"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randrange(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, places):
    words = text.split(" ")
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


BASE = prose(300, 1)
TEXTS = {
    0: BASE, 1: BASE, 2: BASE + " \n", 3: edited(BASE, [10]), 4: edited(BASE, [200, 250]), 5: prose(300, 2), 6: None, 7: "", 8: " \t\r\n",
    9: prose(30_000, 3), 10: "one two three", 11: "one two three", 12: "mail a.b@c-d.example, ring +1 (234) 567-8901 or 10.0.0.1 and 4111 1111 1111 1111.",
    13: "line\nline\nline\n" + prose(60, 4), 14: "漢字 😀 \x00 é" * 40, 15: "x" * 5000, 16: "a a a a a a " * 20, 17: "### " * 80, 18: prose(60, 6) + " 256.1.1.1 x@y",
}


def frame(spark, texts=None):
    rows = [(i, t, None if i == 5 else "en" if (i or 0) % 2 else "fr", None if i == 7 else "s", True, "d", i, "c", "k", 1, "t", 1) for i, t in (TEXTS if texts is None else texts).items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, {})


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_warc(spark):
    long = "y" * 200
    rows = [(3, "http://a b\r\n", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (None, "u", long), (5, "u", None), (6, "u", "é" * 200_000), (6, "u", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read_warc(warc.write_warc(pages, scratch(spark, "test"))).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in found) == [
        (-1, 200, "revisit", 1), (1, 200, "response", None), (2, 5, "response", None), (3, 200, "revisit", 1), (4, 5, "response", None), (5, 0, "response", None), (6, 400_000, "response", None), (6, 400_000, "response", None)]
    assert {bytes(r.payload) for r in found if r.page_id == 6} == {("é" * 200_000).encode()}
    assert all(r.payload_digest == hashlib.sha256(long.encode()).hexdigest() for r in found if r.payload_bytes == 200)
    assert warc.read_warc(warc.write_warc(pages.limit(0), scratch(spark, "test"))).count() == 0


def test_warc_damage_is_found():
    import io

    good = warc.warc_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "2024-01-01T00:00:00Z")
    header, block = next(warc.read_members(io.BytesIO(good)))
    assert warc.parsed(header, block)[4] == 7
    with pytest.raises(warc.WarcError):
        warc.parsed(header, block[:-1] + b"!")
    with pytest.raises(warc.WarcError):
        list(warc.read_members(io.BytesIO(good[:-9])))


def test_language(spark, nothing):
    r = random.Random(1)
    sounds = {"en": "th er ing ou st", "de": "sch ei ung ß ü", "fr": "eau oi é è ç", "es": "ñ ción ll ó rr"}
    rows = {}
    langs = {}
    for i in range(400):
        langs[i] = r.choice(sorted(sounds))
        rows[i] = " ".join("".join(r.choice(sounds[langs[i]].split()) for _ in range(3)) for _ in range(40))
    table = spark.createDataFrame([(i, t, langs[i], 1.0) for i, t in rows.items()] + [(900, None, "en", 1.0), (901, "12 34", "en", 1.0), (902, "", None, 1.0)], "doc_id long, text string, lang string, score double")
    found = {x.doc_id: x for x in langid.predict(table, langid.train(table)).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum(found[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (900, 901, 902)) and all(0 <= x.score <= 1 for x in found.values())
    assert langid.predict(nothing, langid.train(nothing)).count() == 0
    kept = langid.keep_identified(table)
    assert kept.columns == table.columns and kept.count() == 400


def check_pieces(rows, texts):
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.doc_tokens == len(ids)
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, whole in [(parts[i], len(ids_of(t))) for i, t in texts.items()] + [(s, None) for s in sequences.values()]:
        end = 0
        for at, n in sorted(found):
            assert at == end
            end += n
        assert end == whole if whole else end <= 1024
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing(docs, nothing):
    check_pieces(packing.pack(docs, BPE).collect(), TEXTS)
    assert packing.pack(nothing, BPE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000, 1_000_000])
def test_packing_plan(n):
    hist = np.bincount(np.random.default_rng(n).integers(1, 1024, n), minlength=1024)
    plan = packing.slots(hist)
    used = np.zeros(1024, np.int64)
    for length, low, high, _, _ in plan.tolist():
        assert low == used[length]
        used[length] = high
    assert (used == hist).all()
    if n <= 5000:
        windows = defaultdict(list)
        for length, low, high, sequence, offset in plan.tolist():
            for k in range(high - low):
                windows[sequence + k].append((offset, length))
        for pieces in windows.values():
            end = 0
            for at, length in sorted(pieces):
                assert at == end
                end += length
            assert end <= 1024
    if n >= 5000:
        sequences = int((plan[:, 3] + plan[:, 2] - plan[:, 1]).max())
        assert 1 - (hist * np.arange(1024)).sum() / (1024 * sequences) < 0.012


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_near_duplicates(spark, docs, nothing):
    group = {100 + k: edited(BASE, random.Random(k).sample(range(300), k % 14)) for k in range(60)}
    for texts in (TEXTS, TEXTS | group):
        found = probminhash.near_duplicates(frame(spark, texts)).collect()
        classes = brute_classes(texts)
        sizes = Counter(classes.values())
        assert {r.doc_id: (r.class_id, r.class_size, r.kept) for r in found} == {i: (c, sizes[c], c == i) for i, c in classes.items()}
    assert probminhash.near_duplicates(nothing).count() == 0
    odd = frame(spark, {None: BASE}).unionByName(docs.limit(2))
    assert probminhash.near_duplicates(odd).count() == 3


def test_near_duplicates_with_unequal_repeats(spark):
    texts = {}
    for k in range(60):
        one, foot = prose(84, 7000 + k), prose(15, 8000 + k)
        texts |= {2 * k: one, 2 * k + 1: " ".join([one, *[foot] * (8, 16, 64)[k % 3]])}
    found = {r.doc_id: r.class_id for r in probminhash.near_duplicates(frame(spark, texts)).collect()}
    classes = brute_classes(texts)
    assert len(set(classes.values())) == 60 and found == classes


def test_probability_jaccard_is_estimated():
    keys = probminhash.mix(np.arange(1, 1201, dtype=np.uint64))
    one, two = (keys[:1000], np.ones(1000, int)), (keys[200:], np.ones(1000, int))
    s = probminhash.signatures([one, two], 2048)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


def test_exact_duplicates(spark, docs, nothing):
    twice = docs.unionByName(docs.filter("doc_id IN (5, 7)"))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = [*TEXTS, 5, 7]
    groups = defaultdict(list)
    for i in rows:
        groups[norm(TEXTS[i])].append(i)
    for tracked in (2, 1024):
        found = exact.exact_duplicates(twice, tracked).collect()
        assert len(found) == len(rows)
        for r in found:
            own = groups[norm(TEXTS[r.doc_id])]
            assert r.group_size == len(own) and r.keep_id == min(own, key=lambda i: (-len(TEXTS[i] or ""), i))
            assert r.text_sha256 == hashlib.sha256(norm(TEXTS[r.doc_id]).encode()).hexdigest()
        assert sum(r.kept for r in found) == len(groups)
    assert exact.exact_duplicates(nothing).count() == 0
    assert exact.drop_exact_duplicates(twice).count() == len(groups)


def test_sharding(docs, nothing):
    found = sharding.shard(docs, 4).collect()
    slots = defaultdict(list)
    for r in found:
        t = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [4, 5, 5, 5] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(nothing).count() == 0


def test_communication_matrix():
    m = sharding.communication_matrix([5, 0, 100, 3], sharding.shard_sizes(108, 7), 3)
    assert m.sum(axis=1).tolist() == [5, 0, 100, 3] and m.sum(axis=0).tolist() == sharding.shard_sizes(108, 7)


def test_draw_in_parts_is_hypergeometric():
    rng = np.random.default_rng(6)
    x = np.array([sharding.drawn(rng, 50, 50, 80, most=10) for _ in range(3000)])
    assert abs(x.mean() - 40) < 0.25 and abs(x.var() - 80 / 4 * 20 / 99) < 0.6
    big = sharding.communication_matrix([50_000, 10], sharding.shard_sizes(50_010, 3), 3)
    assert big.sum() == 50_010 and 0 < sharding.drawn(rng, 2 * 10**9, 10**9, 50_000) < 50_000


def test_pieces(docs, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in piece.piece_digests(docs, PIECES).collect():
        ids = sp.encode(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = {r.doc_id: r.text for r in piece.decode_pieces(piece.encode_pieces(docs, PIECES), PIECES).collect()}
    assert back == {i: sp.decode(sp.encode(t or "")) for i, t in TEXTS.items()}
    assert piece.piece_digests(nothing, PIECES).count() == 0


def test_piece_table_is_exact():
    import sentencepiece

    sp, codec, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece.PieceCodec(PIECES), random.Random(9)
    for _ in range(4000):
        text = "".join(r.choice("abtheing  \n\t.,é漢😀▁aaa=-") for _ in range(r.randrange(40)))
        assert codec.encode(text) == sp.encode(text)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, nothing, encoding):
    manifest = tokenfiles.write_tokens(docs, scratch(spark, "test"), BPE, encoding=encoding)
    start = 0
    found = {r.doc_id: r for r in tokenfiles.read_tokens(manifest, ("doc_id", "start", "n_tokens", "ids", "ids_crc32")).collect()}
    for i in sorted(TEXTS):
        ids = ids_of(TEXTS[i])
        assert (found[i].start, found[i].n_tokens, found[i].ids, found[i].ids_crc32) == (start, len(ids), ids, crc(ids))
        start += len(ids)
    assert {r.doc_id for r in tokenfiles.read_tokens(manifest, ("doc_id", "n_tokens"), doc_ids=(3, 5)).collect()} == {3, 4, 5}
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(nothing, scratch(spark, "test"), BPE)).count() == 0


def test_special_tokens_are_one_id():
    from tokenizers import Tokenizer

    whole, enc, r = Tokenizer.from_file(BPE), tok.encoder(BPE), random.Random(4)
    texts = ["end.<|endoftext|>Next", "a  <|endoftext|>  b", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n\n"]
    texts += ["".join(r.choice(["<|endoftext|>", " ", "\n", "ab", ".", "<|", "\0"]) for _ in range(12)) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(enc.encode(t, 0), "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0], t


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda v=m[0]: all(int(x) <= 255 for x in v.split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, docs, nothing):
    r = random.Random(2)
    texts = TEXTS | {100 + k: "".join(r.choice("ab1 2.3@+-()._%4") for _ in range(r.randrange(80))) for k in range(500)}
    rows = pii.spans(frame(spark, texts)).collect()
    for x in rows:
        assert [f"{k}:{s.start}:{s.end}" for k in pii.KINDS for s in x[k]] == brute_spans(texts[x.doc_id])
    assert pii.spans(nothing).count() == 0
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert clean[12] == "mail [EMAIL], ring [PHONE] or [IP] and [CARD]." and clean[5] == TEXTS[5] and clean[6] is None


def test_disclosing_terms(spark):
    texts = {k: f"{prose(40, k)} Zanzibarian office a.b@example.org {prose(40, k + 1000)}" for k in range(5)} | {100 + k: prose(80, k + 5000) for k in range(300)}
    found = {r.doc_id: [s.value for s in r.term] for r in pii.spans(frame(spark, texts)).collect()}
    assert all("Zanzibarian" in found[k] for k in range(5)) and not any(found[k] for k in found if k >= 100)
    assert "[NAME]" in next(r.text for r in pii.sanitised(frame(spark, texts)).collect() if r.doc_id == 0)


def test_disclosing_terms_at_edges_and_marks(spark):
    forms = {"end": "{} a.b@example.org Zanzibarian", "newline": "{} a.b@example.org Zanzibarian\n", "marks": "{} (Zanzibarian) a.b@example.org Jean-Xylophon's {}"}
    for form in forms.values():
        texts = {k: form.format(prose(40, k), prose(40, k + 1000)) for k in range(5)} | {100 + k: prose(80, k + 5000) for k in range(300)}
        found = {r.doc_id: [s.value for s in r.term] for r in pii.spans(frame(spark, texts)).collect()}
        assert all({"Zanzibarian", *(["Jean", "Xylophon"] if "Jean" in form else [])} <= set(found[k]) for k in range(5))


def test_context_is_cut_at_words(spark):
    def context(before, after):
        span = F.struct(F.lit(len(before)).alias("from"), F.lit(len(before) + 1).alias("to"))
        return spark.range(1).select(pii._context(F.lit(f"{before}@{after}").cast("binary"), span)).first()[0]

    for n in range(74, 90):
        pad = "." * n
        whole = n + 5 <= pii.CONTEXT
        assert context("", f"{pad} abcd efgh") == (["abcd"] if whole else [])
        assert context(f"efgh abcd {pad}", "") == (["abcd"] if whole else [])
        assert context("", f"{pad} abcd") == (["abcd"] if whole else [])
        assert context(f"abcd {pad}", "") == (["abcd"] if whole else [])
    assert context("", "," * 70 + "abcd,efghij,k") == ["abcd"]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, nothing):
    texts = TEXTS | {100 + k: prose(80 + k, k) for k in range(40)} | {200: "a### b*** " * 30 + prose(90, 77)}
    rows = quality.judged(quality.measures(frame(spark, texts))).collect()
    for r in rows:
        n = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[100 + k] for k in range(40)) and not kept[200] and not kept[17]
    assert quality.judged(quality.measures(nothing)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    stage, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, str(tmp_path))
        assert out.columns == stage.columns
        out.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in stage.select("doc_id").collect()})
    assert kept[0] == set(TEXTS) - {6, 7, 8, 17} and kept[1] == kept[0] - {0, 1, 11} and kept[2] == kept[1] - {3, 4}
    texts = {r.doc_id: r.text for r in stage.collect()}
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), texts)
