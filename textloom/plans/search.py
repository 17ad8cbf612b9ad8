"""Queries that search, list and browse, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.base import keyed, query, sql_similarity, sql_word_similarity, table

PHRASE = "small ring"
#: Similarity from which two names count as alike.
ALIKE = 0.3


def _hits(df: DataFrame, kind: str, key: Column, name: Column, phrase: str, similar: bool = True) -> DataFrame:
    """(kind, key, display, score) of the rows whose name is like the phrase or contains it."""
    score = F.round(T.trigram_similarity(name, F.lit(phrase)), 6)
    found = df.select(F.lit(kind).alias("kind"), key.alias("key"), name.alias("display"), score.alias("score"))
    like = T.literal_like(F.col("display"), phrase)
    return found.filter((F.col("score") >= ALIKE) | like if similar else like)


def _hit_sql(kind: str, key: str, name: str, source: str, phrase: str, similar: bool = True) -> str:
    near = f"{sql_similarity(name, chr(39) + phrase + chr(39))}"
    test = f"(round({near}, 6) >= {ALIKE} OR contains(lower({name}), '{phrase}'))" if similar else f"contains(lower({name}), '{phrase}')"
    return f"SELECT '{kind}' AS kind, {key} AS key, {name} AS display, round({near}, 6) AS score FROM {source} WHERE {test}"


@query("SELECT * FROM (" + " UNION ALL ".join([
    _hit_sql("term", "p_name", "p_name", "(SELECT DISTINCT p_name FROM part)", PHRASE), _hit_sql("term", "min(p_name)", "p_type", "part", PHRASE).replace("WHERE", "WHERE p_size < 50 AND") + " GROUP BY p_type",
    _hit_sql("topic", "p_brand || ':' || p_partkey", "'[{\"lang\":\"hi\",\"text\":\"' || p_name || '\"}]'", "part", PHRASE), _hit_sql("verse", "'o' || o_orderkey", "coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CAST(o_orderkey AS VARCHAR))", "orders", "12", False),
    _hit_sql("interlude", "'k' || s_suppkey", "CAST(s_suppkey AS VARCHAR)", "supplier", "12", False),
]) + ") ORDER BY score DESC, key, kind LIMIT 200")
def search_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits among terms and their aliases, topics by what they display, verses and interludes by their number, in one ranking."""
    part, orders, supplier = (table(spark, sf_dir, t) for t in ("part", "orders", "supplier"))
    display = F.to_json(F.array(F.struct(F.lit("hi").alias("lang"), F.col("p_name").alias("text"))))
    aliases = part.filter("p_size < 50").groupBy("p_type").agg(F.min("p_name").alias("term"))
    number = F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")), F.col("o_orderkey").cast("string"))
    found = [
        _hits(part.select("p_name").distinct(), "term", F.col("p_name"), F.col("p_name"), PHRASE),
        _hits(aliases, "term", F.col("term"), F.col("p_type"), PHRASE),
        _hits(part, "topic", F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string")), display, PHRASE),
        _hits(orders, "verse", keyed("o", "o_orderkey"), number, "12", False),
        _hits(supplier, "interlude", keyed("k", "s_suppkey"), F.col("s_suppkey").cast("string"), "12", False),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.orderBy(F.desc("score"), "key", "kind").limit(200)


_ADMIN = [("work", "p_brand", "p_name", "part"), ("author", "'a' || n_nationkey", "n_name", "nation"), ("commentary", "'t' || r_regionkey", "r_name", "region"), ("book", "'b' || c_custkey", "c_name", "customer"), ("talk", "'v' || s_suppkey", "s_name", "supplier")]


@query("SELECT DISTINCT * FROM (" + " UNION ALL ".join(_hit_sql(k, key, name, source, "nation 1") for k, key, name, source in _ADMIN) + ")")
def admin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit among works, authors, commentaries, books and talks."""
    out = None
    for kind, key, name, source in _ADMIN:
        found = _hits(table(spark, sf_dir, source), kind, F.expr(key), F.col(name), "nation 1")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


@query(f"""SELECT n_nationkey AS key, round(sim, 6) AS score FROM (SELECT n_nationkey, greatest({sql_similarity('n_name', "'nation 12'")}, {sql_similarity("'author ' || n_nationkey", "'nation 12'")}) AS sim FROM nation) WHERE round(sim, 6) >= 0.25 ORDER BY score DESC, key LIMIT 50""")
def fuzzy_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors by the better of two names, from 0.25 on, at most 50."""
    two = F.greatest(T.trigram_similarity(F.col("n_name"), F.lit("nation 12")), T.trigram_similarity(keyed("author ", "n_nationkey"), F.lit("nation 12")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.round(two, 6).alias("score")).filter("score >= 0.25").orderBy(F.desc("score"), "key").limit(50)


ASKED = "small gear nation"


@query(f"""WITH authors AS (SELECT n_nationkey AS id, n_name AS name FROM nation), ws AS (SELECT id, CASE WHEN w >= 0.5 THEN w ELSE 0 END AS w FROM (SELECT id, {sql_word_similarity('nation', 'name')} AS w FROM authors)),
author_sim AS (SELECT a.id, a.name, greatest({sql_similarity('a.name', f"'{ASKED}'")}, w) AS sim FROM authors a JOIN ws USING (id)),
commentary AS (SELECT s_suppkey AS tid, s_suppkey % 200 AS work, s_nationkey AS author, 'supplier ' || s_suppkey AS name FROM supplier),
teeka AS (SELECT work, greatest({sql_similarity('c.name', f"'{ASKED}'")}, coalesce(a.sim, 0)) AS sim, CASE WHEN coalesce(a.sim, 0) > {sql_similarity('c.name', f"'{ASKED}'")} THEN 'commentator' ELSE 'commentary' END AS kind,
 CASE WHEN coalesce(a.sim, 0) > {sql_similarity('c.name', f"'{ASKED}'")} THEN a.name ELSE c.name END AS detail, tid FROM commentary c LEFT JOIN author_sim a ON a.id = c.author AND a.id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY work ORDER BY round(sim, 6) DESC, tid) = 1),
r AS (SELECT p_partkey AS work, round({sql_similarity('p_name', f"'{ASKED}'")}, 6) AS name_sim, round(coalesce(t.sim, 0), 6) AS teeka_sim, t.kind, t.detail, round(coalesce(a.sim, 0), 6) AS author_sim FROM part LEFT JOIN teeka t ON t.work = p_partkey LEFT JOIN author_sim a ON a.id = p_size)
SELECT work, greatest(name_sim, teeka_sim, author_sim) AS score, CASE WHEN name_sim >= author_sim AND name_sim >= teeka_sim THEN 'name' WHEN author_sim >= teeka_sim THEN 'author' ELSE kind END AS field, CASE WHEN NOT (name_sim >= author_sim AND name_sim >= teeka_sim) AND author_sim < teeka_sim THEN detail END AS detail
FROM r WHERE greatest(name_sim, teeka_sim, author_sim) >= 0.25 ORDER BY score DESC, work LIMIT 50""")
def fuzzy_works_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by their own name, their author's, or the best of their commentaries' or commentators' names, and which it was.

    On ties the own name goes before the author, the author before a commentary; a part of a person's name counts from 0.5.
    """
    part, nation, supplier = (table(spark, sf_dir, t) for t in ("part", "nation", "supplier"))
    asked = F.lit(ASKED)
    # No two names are compared twice: persons and commentaries have their similarities before they are joined.
    fragment = T.word_similarity(F.lit("nation"), F.col("name"))
    people = nation.select(F.col("n_nationkey").alias("author"), F.col("n_name").alias("name"))
    people = people.withColumn("sim", F.greatest(T.trigram_similarity(F.col("name"), asked), F.when(fragment >= 0.5, fragment).otherwise(0.0)))
    own = supplier.select("s_suppkey", (F.col("s_suppkey") % 200).alias("work"), F.col("s_nationkey").alias("author"), keyed("supplier ", "s_suppkey").alias("title"))
    own = own.withColumn("own_sim", T.trigram_similarity(F.col("title"), asked))
    known = F.broadcast(people.filter("author % 2 = 0"))
    both = own.join(known, "author", "left").withColumn("by_person", F.coalesce("sim", F.lit(0.0)) > F.col("own_sim"))
    both = both.select("work", F.round(F.greatest("own_sim", F.coalesce("sim", F.lit(0.0))), 6).alias("best"), "s_suppkey", F.when(F.col("by_person"), "commentator").otherwise("commentary").alias("kind"), F.when(F.col("by_person"), F.col("name")).otherwise(F.col("title")).alias("detail"))
    best = both.groupBy("work").agg(F.min(F.struct((-F.col("best")).alias("low"), "s_suppkey", "kind", "detail")).alias("b"))
    rows = part.select(F.col("p_partkey").alias("work"), F.col("p_size").alias("author"), F.round(T.trigram_similarity(F.col("p_name"), asked), 6).alias("name_sim"))
    rows = rows.join(best, "work", "left").join(F.broadcast(people.select("author", F.round("sim", 6).alias("person"))), "author", "left")
    rows = rows.withColumn("teeka_sim", F.coalesce(-F.col("b.low"), F.lit(0.0))).withColumn("author_sim", F.coalesce("person", F.lit(0.0)))
    by_name = (F.col("name_sim") >= F.col("author_sim")) & (F.col("name_sim") >= F.col("teeka_sim"))
    by_author = F.col("author_sim") >= F.col("teeka_sim")
    out = rows.select("work", F.greatest("name_sim", "teeka_sim", "author_sim").alias("score"), F.when(by_name, "name").when(by_author, "author").otherwise(F.col("b.kind")).alias("field"), F.when(~by_name & ~by_author, F.col("b.detail")).alias("detail"))
    return out.filter("score >= 0.25").orderBy(F.desc("score"), "work").limit(50)


#: Filters that read alike in both dialects; books are those that some row of a bridge table names.
LISTS = {
    "terms": ("part", "p_name", "p_name LIKE 'b%'"),
    "topics": ("part", "p_name", "p_type = 'ECONOMY' AND p_size % 2 = 0"),
    "verses": ("orders", "o_orderkey", "o_custkey IN (1, 2, 3) OR o_orderstatus IS NULL"),
    "interludes": ("lineitem", "l_orderkey", "l_linenumber = 7 AND l_suppkey = 3"),
    "works": ("customer", "c_name", "contains(lower(c_name), '#00000')"),
    "commentaries": ("supplier", "s_name", "s_nationkey = 3"),
    "authors": ("nation", "n_name", "contains(lower(n_name), '_1')"),
    "books": ("part", "p_name", "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)"),
    "talks": ("events", "event_id", "event_type = 'error' AND user_id = 8"),
    "publications": ("region", "r_name", "r_regionkey > 1"),
}


@query(" UNION ALL ".join(f"(SELECT '{k}' AS list, CAST({key} AS VARCHAR) AS key, (SELECT count(DISTINCT {key}) FROM {t} WHERE {where}) AS total FROM (SELECT DISTINCT {key} FROM {t} WHERE {where}) ORDER BY {key} LIMIT 15 OFFSET 2)" for k, (t, key, where) in LISTS.items()))
def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each of ten filtered lists, with its total: equality, sets, nulls, prefix, substring, and a bridge table."""
    out = None
    for name, (source, key, where) in LISTS.items():
        rows = table(spark, sf_dir, source)
        if name == "books":
            bridge = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
            rows = rows.join(bridge, "p_partkey", "left_semi")
        else:
            rows = rows.filter(where)
        keys = rows.select(key).distinct()
        page = keys.orderBy(key).offset(2).limit(15).select(F.lit(name).alias("list"), F.col(key).cast("string").alias("key"))
        page = page.crossJoin(F.broadcast(keys.agg(F.count(F.lit(1)).alias("total"))))
        out = page if out is None else out.unionByName(page)
    return out


@query("SELECT * FROM (SELECT 'id' AS how, c_custkey AS id, c_name FROM customer WHERE c_custkey = 17 OR c_name = '17' UNION ALL SELECT 'key', c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000021')")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its id or by its natural key; both reach the scan as filters."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    one = lambda how, ident: rows.filter((F.col("id") == int(ident)) | (F.col("c_name") == ident) if ident.isdecimal() else F.col("c_name") == ident).select(F.lit(how).alias("how"), "id", "c_name")
    return one("id", "17").unionByName(one("key", "Customer#000000021"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 5)")
def batched_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of the documents of a set of keys."""
    wanted = table(spark, sf_dir, "lineitem").filter("l_partkey = 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(wanted, "o_orderkey", "left_semi")


@query("""SELECT o_custkey AS work, o_orderpriority AS section, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members, min(o_orderkey) AS first_seen, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) AS place
FROM orders GROUP BY 1, 2""")
def work_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verses of the sections of every work; sections in the order in which they are first seen."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("work"), F.col("o_orderpriority").alias("section")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("m"), F.min("o_orderkey").alias("first_seen"))
    place = F.row_number().over(Window.partitionBy("work").orderBy("first_seen")).cast("long")
    return rows.select("work", "section", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"), "first_seen", place.alias("place"))


@query("""SELECT 'orders' AS entity, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'nodes', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)""")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each entity has."""
    one = lambda name, *tables: table(spark, sf_dir, tables[0]).select(F.lit(name).alias("entity")) if len(tables) == 1 else one(name, tables[0]).unionByName(one(name, *tables[1:]))
    rows = one("orders", "orders").unionByName(one("parts", "part")).unionByName(one("customers", "customer")).unionByName(one("nodes", "nation", "region"))
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, strftime(coalesce(CASE WHEN event_id % 3 = 0 THEN ts END, CASE WHEN event_id % 3 = 1 THEN ts END, TIMESTAMP '2024-01-01 00:00:00'), '%Y-%m-%dT%H:%M:%S') AS at, coalesce(CAST(props->>'$.k' AS BIGINT), 0) AS touched
FROM events ORDER BY CASE WHEN event_id % 5 <> 0 THEN ts END DESC NULLS FIRST, event_id LIMIT 30""")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest runs, unfinished ones first: when they ended, began or were made, and how many entities they touched."""
    rows = table(spark, sf_dir, "events").orderBy(F.desc_nulls_first(F.when(F.col("event_id") % 5 != 0, F.col("ts"))), "event_id").limit(30)
    at = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.when(F.col("event_id") % 3 == 1, F.col("ts")), F.lit("2024-01-01 00:00:00").cast(dict(rows.dtypes)["ts"]))
    return rows.select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), F.lit(0)).alias("touched"))


@query("""SELECT upper(substr(word, 1, 1)) AS letter, count(*) AS n FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT lower(r_name) FROM region) GROUP BY 1""")
def first_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different words begin with each letter."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(table(spark, sf_dir, "region").select(F.lower("r_name").alias("word"))).distinct()
    return words.groupBy(F.upper(F.substring("word", 1, 1)).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, concat_ws(', ', p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END) AS names, list_max([l.q, 0]) AS most FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey""")
def names_and_bests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined names without nulls, and the greatest of a child's numbers, 0 without children."""
    most = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"))
    rows = table(spark, sf_dir, "part").join(most, "p_partkey", "left")
    return rows.select("p_partkey", F.array_join(F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type"))), ", ").alias("names"), F.greatest("q", F.lit(0.0)).alias("most"))
