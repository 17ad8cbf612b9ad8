"""Merges into stored tables, validators, envelopes and routing on small cases."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import blocks as B
from textloom.functions import keys as K
from textloom.functions import text as T
from textloom.operators import envelope, graph, merge, resolve, routing, store
from textloom.sources import dictionary


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values)).select(column).first()[0]


def test_every_suffix(spark):
    stem = "कमल"
    for s in T.SUFFIXES:
        first = next(x for x in T.SUFFIXES if (stem + s).endswith(x) and len(stem + s) > len(x) + 1)
        assert value(spark, T.strip_suffix(F.col("a")), a=stem + s) == (stem + s)[: -len(first)]
    assert value(spark, T.strip_suffix(F.col("a")), a="घरोंमें") == "घर" and value(spark, T.strip_suffix(F.col("a")), a="का") is None
    assert value(spark, T.strip_end_mark(F.col("a")), a="dharmam") == "dharma" and value(spark, T.strip_end_mark(F.col("a")), a="m") is None


def test_long_numbers_and_empty_sets(spark):
    assert value(spark, T.verses(F.col("a")), a="x ॥99999999999॥ y ॥99999999999999999999॥")[0].number == 99999999999
    none = F.array().cast("array<string>")
    assert value(spark, T.jaccard(none, none), a="") == 0 and value(spark, T.jaccard(none, none, 1.0), a="") == 1


def test_coverage(spark):
    assert value(spark, T.coverage_tokens(F.split("a", " ")), a="सत् व सत x Red/Bolt") == ["सत", "redbolt"]
    assert value(spark, T.covered(T.segments(F.col("a")), F.array(F.lit("सत"), F.lit("zz"))), a="पंचास्तिकाय:सत्-रूप") == 0.5
    assert value(spark, T.covered(T.segments(F.col("a")), F.array().cast("array<string>")), a="x") == 1


def test_validators(spark):
    for bad in ([], ["x"] * 33):
        with pytest.raises(ValueError):
            resolve.token_rows(spark, bad)
    tokens = resolve.token_rows(spark, ["a", "a", "b‍ "])
    assert [(r.pos, r.norm) for r in tokens.collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        resolve.suggestions(tokens, tokens, tokens, 21)
    with pytest.raises(ValueError):
        resolve.topics_match(tokens, " ")


def test_fuzzy_seeds(spark):
    terms = spark.createDataFrame([("bolt",), ("gear",)], "term string")
    aliases = spark.createDataFrame([], "alias string, term string")
    nodes = spark.createDataFrame([("bolt", "keyword", None), ("T", "topic", True)], "nk string, label string, is_leaf boolean")
    edges = spark.createDataFrame([(1, "HAS_TOPIC", "bolt", "T", 1.0)], "edge_id long, type string, src string, dst string, weight double")
    run = lambda fuzzy: resolve.graphrag(resolve.token_rows(spark, ["bolts"]), terms, aliases, nodes, edges, fuzzy=fuzzy).collect()
    assert run(False) == [] and [(r.topic, r.overlap, r.score) for r in run(True)] == [("T", 1, 11.0)]


def test_upsert(spark, tmp_path):
    schema = "k string, v int, created_at string, sources array<string>"
    path = str(tmp_path / "t")
    store.upsert_table(spark, path, spark.createDataFrame([("a", 1, "old", ["x"]), ("b", 2, "old", ["x"])], schema), "k")
    new = spark.createDataFrame([("b", None, "new", ["y"]), ("c", 3, "new", ["y"]), ("c", 3, "new", ["z"])], schema)
    for _ in range(2):
        found = store.upsert_table(spark, path, new, "k").collect()
        assert sorted((r.k, r.v, r.created_at, r.sources) for r in found) == [("a", 1, "old", ["x"]), ("b", 2, "old", ["x", "y"]), ("c", 3, "new", ["y", "z"])]
    with pytest.raises(ValueError):
        store.upsert_table(spark, path, spark.createDataFrame([(None, 1, "", [])], schema), "k")
    null = spark.createDataFrame([(None, 1, "", ["x"])], schema)
    assert merge.upsert(null, null, "k").count() == 1
    both = store.overwrite(spark.read.parquet(path).filter("k <> 'a'"), path)
    assert both.count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_edges_and_cascades(spark):
    edges = spark.createDataFrame([("IS_A", "a", "b", None, None, None, 1.0)], "type string, src string, dst string, block_index int, section_index int, definition_index int, weight double")
    twice = store.merge_edges(store.merge_edges(edges, edges), edges)
    assert [tuple(r) for r in twice.collect()] == [("IS_A", "a", "b", -1, -1, -1, 1.0)]
    with pytest.raises(ValueError):
        store.merge_edges(edges, edges.withColumn("type", F.lit("NO")))
    rows = spark.createDataFrame([("x", "p"), ("y", None)], "nk string, parent string")
    parents = spark.createDataFrame([("p", 7)], "nk string, id int")
    assert {(r.nk, r.parent_id) for r in store.with_parents(rows, parents, "parent").collect()} == {("x", 7), ("y", None)}
    with pytest.raises(KeyError):
        store.with_parents(rows, parents.limit(0), "parent")
    with pytest.raises(KeyError):
        store.patched(parents, spark.createDataFrame([("q", 1)], "nk string, id int"), "nk")


def test_paths_and_cycles(spark):
    edges = spark.createDataFrame([(1, "X", "a", "b", None), (2, "X", "c", "b", None), (3, "X", "c", "a", None), (4, "X", "c", "d", None)], "edge_id long, type string, src string, dst string, weight double")
    path = lambda a, b, n=6: [r.nk for r in graph.shortest_path(edges, a, b, n).orderBy("place").collect()]
    assert path("a", "d") == ["a", "c", "d"] and path("a", "d", 1) == [] and path("a", "a") == ["a"] and path("a", "z") == []
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "nk string, parent string")
    assert {r.nk: r.chain for r in graph.chains(loop, 9).collect()}["c"] == ["b", "a"]


def test_references(spark):
    ref = lambda inline, *fields: {"inline": inline, "work_name": "w", "commentary_name": "", "fields": [{"field": f, "value": v} for f, v in fields]}
    cases = {"a": [ref(True, ("verse", "1")), ref(False)], "b": [ref(True, ("verse", "1")), ref(True, ("verse", "2"))], "c": [ref(False, ("verse", "3"), ("verse", "4"), ("page", "x"))], "d": None, "e": []}
    rows = spark.createDataFrame([(k, [{"kind": "hindi_text", "text": "t" * 1501, "translation": " ", "references": v}]) for k, v in cases.items()], f"k string, blocks array<{B.BLOCK}>")
    found = {r.k: r for r in rows.select("k", B.extracts(F.col("blocks"), cap=1).alias("x"), B.shown_places(F.get("blocks", 0)["references"]).alias("at"), F.size(B.hidden_references(F.get("blocks", 0)["references"])).alias("hidden")).collect()}
    assert {k: (r.at, r.hidden) for k, r in found.items()} == {"a": ([], 1), "b": ([0], 1), "c": ([0], 0), "d": ([], 0), "e": ([], 0)}
    assert found["c"].x[0].references[0].asDict() == {"work": "w", "verse": 4, "commentary": None, "page": None} and len(found["c"].x[0].text) == 1501
    assert value(spark, B.field_map(F.array(F.struct(F.lit("f").alias("field"), F.lit("1").alias("value")), F.struct(F.lit("f").alias("field"), F.lit("2").alias("value")))), a="") == {"f": "2"}


def test_keys(spark):
    assert value(spark, K.any_width(F.col("a")), a="w:अधिकार:01:गाथा:007:टीका:san") == "w:अधिकार:01:गाथा:7:टीका:san"
    assert value(spark, K.any_width(F.col("a")), a="w:000") == "w:0" and value(spark, K.verse_number(F.col("a")), a="w:x") is None
    assert value(spark, K.numbered(F.col("a"), F.lit(123)), a="p") == "table:p:123"


def test_thresholds_of_a_route(spark):
    routes = {(r.label, r.block_kind): r.collection for r in routing.routes(spark).collect()}
    assert len(routes) == 11 and routes["Gatha", "sanskrit_text"] == "gatha_sanskrit"


def test_redlinks(spark):
    html = '<div class=mw-parser-output><strong id="1">h</strong><p class=HindiText>देखें <a href="/w?title=N&redlink=1">n</a></p></div>'
    rows = dictionary.page_rows(spark.createDataFrame([(1, "/wiki/x", html), (2, None, None)], "page_id long, url string, html string"))
    count = lambda mode: envelope.envelope(rows, mode)["edges"].filter("type = 'RELATED_TO'").count()
    assert [count(m) for m in envelope.REDLINKS] == [1, 0, 0]
    with pytest.raises(ValueError):
        envelope.envelope(rows, "sometimes")


def test_apply_twice(spark, tmp_path):
    page = lambda inner: f"<div class=mw-parser-output>{inner}</div>"
    one = page('<p class=HindiText>d</p><strong id="1">h</strong><p class=HindiText>देखें <a href="/wiki/b#2.1">b</a></p>')
    two = page('<strong id="2.1">deep</strong><p class=HindiText>t</p>')
    rows = lambda k, term, html: dictionary.page_rows(spark.createDataFrame([(k, f"/wiki/{term}", html)], "page_id long, url string, html string"))
    folder = str(tmp_path / "store")
    read = lambda name: sorted(map(str, spark.read.parquet(f"{folder}/{name}").collect()))
    envelope.apply(spark, folder, envelope.envelope(rows(1, "a", one)), "x")
    assert ("b:2.1", True) in {(r.nk, r.is_stub) for r in spark.read.parquet(f"{folder}/nodes").collect()}
    envelope.apply(spark, folder, envelope.envelope(rows(2, "b", two)), "x")
    before = {n: read(n) for n in ("terms", "topics", "definitions", "extracts", "nodes", "edges")}
    nodes = {r.nk: r.is_stub for r in spark.read.parquet(f"{folder}/nodes").collect()}
    assert "b:2.1" not in nodes and nodes["b:2:deep"] is False
    assert ("RELATED_TO", "a:h", "b:2:deep") in {tuple(r) for r in spark.read.parquet(f"{folder}/edges").select("type", "src", "dst").collect()}
    envelope.apply(spark, folder, envelope.envelope(rows(2, "b", two)), "x")
    assert before == {n: read(n) for n in before}


def test_registry(spark, tmp_path):
    import json

    from textloom.sources import config

    path = tmp_path / "works.json"
    path.write_text(json.dumps([{"name": "A", "formats": ["x"], "page_offsets": [[10, 2], [99, 5]]}, {"name": "B", "commentary_of": "A"}]))
    entries = config.read_registry(spark, str(path))
    table = config.registry_table(spark, entries)
    assert table.select(T.page_offset(F.lit(40), F.col("page_offsets"))).first()[0] == 5 and table.count() == 2
    for bad in ({}, [{"x": 1}], [{"name": "A", "y": 1}], [{"name": "A"}, {"name": "A"}], [{"name": "A", "commentary_of": "Z"}], [{"name": "A", "formats": "x"}]):
        with pytest.raises(ValueError):
            config.checked(bad)
    assert config.safe_path("/a/b", "c/../d.pdf") == "/a/b/d.pdf"
    for bad in ("../x", "/etc/passwd", "c/../../x", ".."):
        with pytest.raises(ValueError):
            config.safe_path("/a/b", bad)


def test_threshold_settings(spark):
    from textloom.operators import alignment

    pair = spark.createDataFrame([("abcdefghij", "abcdefghxj klm", "hindi_text")], "source string, target string, kind string")
    assert alignment.align(pair).first().threshold == 0.8 and alignment.align(pair).first().status == "unmatched"
    spark.conf.set("textloom.threshold.hindi_text", "0.3")
    try:
        assert alignment.align(pair).first().status == "matched"
    finally:
        spark.conf.unset("textloom.threshold.hindi_text")


def test_report(spark, tmp_path):
    store.write_report(spark.createDataFrame([("a", 1)], "k string, n int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().n == 1
