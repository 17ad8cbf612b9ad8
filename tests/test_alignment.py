import random

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.alignment import Sieve, align, best_window, grams, locate, normalised, plain_form
from textloom.plans import registry
from textloom.sources.html import page_rows, parse


def brute(source, target, begin, step):
    wanted, best, where = set(grams(source)), 0.0, -1
    for i in range(begin, len(target) - len(source) + 1):
        if (i - begin) % step == 0:
            have = set(grams(target[i : i + len(source)]))
            score = len(wanted & have) / len(wanted | have)
            if score > best:
                best, where = score, i
    return best, where


def test_best_window_like_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        source, target = ("".join(rng.choices("abc", k=rng.randint(0, k))) for k in (9, 30))
        begin, step = rng.randint(0, 4), rng.randint(1, 3)
        if source:
            got, want = best_window(source, target, begin, step), brute(source, target, begin, step)
            assert abs(got[0] - want[0]) < 1e-12 and got[1] == want[1], (source, target, begin, step)
    assert best_window("", "abc") == (0.0, -1)


def test_normalised_forms_agree_and_keep_places():
    assert normalised("पर्क्कट").text == normalised("पर्कट").text
    assert normalised("लशिकं उदय").text == normalised("लशिकम् उदय").text
    assert normalised("टूगं दा ।४७।").text == normalised("टूगन्दा").text
    t = normalised("a - b, c 12 d")
    assert (t.text, t.place) == ("abcd", [0, 4, 7, 12])


def test_locate():
    target = "Old roads lead - home; the river bends twice before the mill."
    assert locate("roads lead home", target)[:2] == ("exact_normalized", 1.0)
    assert target[slice(*locate("roads lead home", target)[2:])] == "roads lead - home"
    found = locate("roads lead... the mill", target)
    assert (found.method, target[found.char_start : found.char_end]) == ("exact_normalized_ellipsis", "roads lead - home; the river bends twice before the mill")
    assert locate("the mill... roads lead", target).method == "none"
    near = locate("the river bendz twice before the mill", target, 0.7)
    assert near.method == "shingle_fuzzy" and target[near.char_start : near.char_end].startswith("the river")
    assert locate("", target).method == locate(None, None).method == locate("x" * 99, target).method == "none"


def test_align_defined_results(spark):
    rows = spark.createDataFrame([(1, "ab cd", "xx ab, cd yy", "hindi_text", "k"), (2, "ab", None, None, "k"), (3, None, "ab", "other", "k")], "id long, source string, target string, kind string, method string")
    out = {r.id: r for r in align(rows).collect()}
    assert (out[1].status, out[1].char_start, out[1].char_end) == ("matched", 3, 9)
    assert (out[2].status, out[3].status, out[3].threshold) == ("target_missing", "unmatched", 0.8)
    assert align(rows.limit(0)).count() == 0


def test_page_rows(spark):
    page = "<h1>A</h1><p>x <a href='/u?a=1&amp;b'>go <b>on</b></a> y</p><h2>B</h2><table><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr></table><script>no</script><p>open"
    rows = parse(page)
    assert [(r[0], r[2], r[3]) for r in rows if r[0] in ("heading", "block")] == [("heading", "1", "A"), ("block", "1", "x go on y"), ("heading", "1.1", "B"), ("block", "1.1", "open")]
    assert [(r[3], r[4]) for r in rows if r[0] == "link"] == [("go on", "/u?a=1&b")]
    assert [r[3:4] + r[6:] for r in rows if r[0] == "cell"] == [("r", 0, 0), ("r", 1, 0), ("1", 0, 1), ("2", 1, 1)]
    pages = spark.createDataFrame([(1, page, 0), (2, None, 0), (3, "", 0), (4, "<td>a</table></td><h9>", 0)], "page_id long, html string, row int")
    assert {r.page_id for r in page_rows(pages).collect()} == {1, 4}


def test_word_similarity(spark):
    def value(a, b):
        return spark.range(1).select(T.word_similarity(F.lit(a), F.lit(b))).first()[0]

    assert abs(value("word", "two words") - 0.8) < 1e-12
    assert value("word", "a word here") == 1.0
    assert value("", "x") == value("x", "") == 0.0


def test_numbers_and_verses(spark):
    row = spark.createDataFrame([("098-100", "aa ॥१॥ bb ॥२॥ c", "x y x")], "a string, v string, w string")
    assert row.select(T.padded_range(F.col("a"))).first()[0] == ["098", "099", "100"]
    assert [tuple(r) for r in row.select(T.verses(F.col("v"))).first()[0]] == [(1, "aa"), (2, "bb")]
    words = F.array(F.lit("x"), F.lit("x"), F.lit("y"), F.lit("q"))
    assert [tuple(r) for r in row.select(T.word_offsets(words, F.col("w"))).first()[0]] == [("x", 0), ("x", 4), ("y", 2), ("q", None)]
    keys = spark.createDataFrame([(k,) for k in ("w:10", "w:9", "w:x", "w:०८")], "k string")
    assert [r.k for r in keys.orderBy(*T.numeric_order(F.col("k"))).collect()] == ["w:०८", "w:9", "w:10", "w:x"]


def test_align_passages_finds_what_verbatim_search_finds(spark):
    sf = "/root/testdata/sf0.001"
    near = {(r.doc_id, r.item_id) for r in registry.QUERIES["align_passages"](spark, sf).collect()}
    exact = {(r.doc_id, r.item_id) for r in registry.QUERIES["locate_passages"](spark, sf).collect()}
    assert exact and exact <= near
    assert registry.QUERIES["fuzzy_works"](spark, sf).count() <= 50 and registry.QUERIES["page_rows"](spark, sf).count() > 0


def test_sieve_loses_no_match():
    rng = random.Random(8)
    matched = 0
    for _ in range(600):
        target = "".join(rng.choices("abcd ,", k=rng.randint(0, 300)))
        sources = []
        for _ in range(8):
            at, n = rng.randrange(300), rng.randint(1, 40)
            s = list(target[at : at + n])
            for _ in range(rng.randint(0, 2)):
                s.insert(rng.randint(0, len(s)), rng.choice(["x", "...", ", ", "a"]))
            sources.append("".join(s))
        assert plain_form(target) == normalised(target).text
        passed = Sieve([(s, 0.8) for s in sources]).may_match(plain_form(target))
        hits = [i for i, s in enumerate(sources) if locate(s, target, 0.8).method != "none"]
        matched += len(hits)
        assert set(hits) <= set(passed), (target, sources)
    assert matched > 1000


def test_every_window_of_a_long_target_is_scored():
    rng = random.Random(3)
    words = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    source = words(100)
    for at in range(5037, 15000, 997):
        target = words(at) + source[:50] + "z" + source[51:] + words(20000 - at)
        found = locate(source, target)
        assert (found.method, found.char_start) == ("shingle_fuzzy", at)


def test_passages_with_other_marks_and_short_ones(spark, tmp_path):
    words = "old roads lead home past the river mill and over nine green hills".split()
    marked = " ".join(w + (" -" if k % 3 == 2 else "") for k, w in enumerate(words))
    spark.createDataFrame([(1, f"Once {marked} again."), (2, "two words, no more"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(words)), (8, "two words"), (9, None), (10, "mill")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = {(r.doc_id, r.item_id): r.method for r in registry.QUERIES["align_passages"](spark, str(tmp_path)).collect()}
    assert near == {(1, 7): "exact_normalized", (1, 10): "exact_normalized", (2, 8): "exact_normalized"}
    exact = {(r.doc_id, r.item_id, r.char_start, r.char_end) for r in registry.QUERIES["locate_passages"](spark, str(tmp_path)).collect()}
    start = f"Once {marked}".index("mill")
    assert exact == {(1, 10, start, start + 4), (2, 8, 0, 9)}
