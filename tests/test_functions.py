from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import graph, merge


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


def test_trigram_similarity(spark):
    def sets(x):
        return {("  " + w + " ")[i : i + 3] for w in x.lower().split() for i in range(len(w) + 1)}

    for a, b in (("red bolt", "red bolts"), ("abc", "abc"), ("", "x"), ("a b", "b a")):
        union = sets(a) | sets(b)
        assert abs(one(spark, T.trigram_similarity(F.col("a"), F.col("b")), a=a, b=b) - len(sets(a) & sets(b)) / max(1, len(union))) < 1e-12


def test_keys(spark):
    assert one(spark, T.canonical_key(F.col("a")), a="work:verse:012:x:000") == "work:verse:12:x:0"
    assert one(spark, T.breadcrumb(F.col("a")), a="a-b:c:d") == ["a b", "c"]
    assert one(spark, T.parent_path(F.col("a")), a="1.2.3") == "1.2"
    assert one(spark, T.parent_path(F.col("a")), a="1") is None
    assert one(spark, T.slug(F.col("a")), a="1.2 Red  & blue") == "Red-blue"


def test_ranges(spark):
    assert one(spark, T.expand_ranges(F.col("a")), a="1-3,39") == [1, 2, 3, 39]
    assert one(spark, T.expand_ranges(F.col("a")), a="1-x") is None
    assert one(spark, T.expand_ranges(F.col("a")), a="1-99") is None


def test_suffix(spark):
    assert one(spark, T.strip_suffix(F.col("a"), ["ings", "s"]), a="gears") == "gear"
    assert one(spark, T.strip_suffix(F.col("a"), ["ings", "s"]), a="as") is None


def test_html(spark):
    assert one(spark, T.html_text(F.col("a")), a="<p>a &amp; b<br>c<script>x</script></p>") == "a & b\nc"


def test_merge_is_idempotent_and_keeps_real_nodes(spark):
    old = spark.createDataFrame([("a", "real", False, ["x"])], "nk string, title string, is_stub boolean, sources array<string>")
    stub = spark.createDataFrame([("a", None, True, ["y"]), ("b", None, True, ["y"])], old.schema)
    first = merge.merge_stubs(old, stub)
    rows = {r.nk: (r.title, r.is_stub, r.sources) for r in first.collect()}
    assert rows == {"a": ("real", False, ["x", "y"]), "b": (None, True, ["y"])}
    assert sorted(map(str, merge.merge_stubs(first, stub).collect())) == sorted(map(str, first.collect()))


def test_gated_neighbours_pass_empty_topics_for_free(spark):
    edges = spark.createDataFrame([(1, "RELATED_TO", "A", "B", None), (2, "RELATED_TO", "B", "C", None), (3, "RELATED_TO", "C", "D", None)], "edge_id long, type string, src string, dst string, weight double")
    topics = spark.createDataFrame([("A", 1), ("B", 0), ("C", 1), ("D", 1)], "nk string, content int")
    anchors = spark.createDataFrame([("A",)], "nk string")
    assert {(r.topic, r.hops) for r in graph.gated_neighbours(anchors, edges, topics, 1).collect()} == {("C", 1)}
    assert {(r.topic, r.hops) for r in graph.gated_neighbours(anchors, edges, topics, 2).collect()} == {("C", 1), ("D", 2)}


def test_trails_repeat_no_edge(spark):
    edges = spark.createDataFrame([(1, "RELATED_TO", "A", "B", 2.0), (2, "RELATED_TO", "A", "B", 3.0)], "edge_id long, type string, src string, dst string, weight double")
    nodes = spark.createDataFrame([("A",), ("B",)], "nk string")
    found = graph.traverse(nodes.filter("nk = 'A'"), edges, nodes, 3).collect()
    assert sorted((r.topic, r.path_weight, r.hops) for r in found) == [("B", 2.0, 1), ("B", 3.0, 1)]


def test_sums_of_trails(spark):
    import random

    r = random.Random(3)
    rows = [(k, "X", f"n{r.randrange(7)}", f"n{r.randrange(7)}", r.choice([None, 0.5, 2.0])) for k in range(16)]
    edges = spark.createDataFrame(rows, "edge_id long, type string, src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(7)], "nk string")
    seeds = nodes.filter("nk IN ('n0', 'n1')")
    for hops in (1, 2, 3):
        one = graph.traverse(seeds, edges, nodes, hops).groupBy("seed", "topic").agg(F.sum("path_weight").alias("weight"))
        two = graph.trail_sums(seeds, edges, nodes, hops)
        plain = lambda df: {(x.seed, x.topic): round(x.weight, 9) for x in df.collect()}
        assert plain(one) == plain(two)
