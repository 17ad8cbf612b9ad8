"""Each registered query against its SQL on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from textloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    value = lambda v: round(float(v), 6) if isinstance(v, float | Decimal) else v
    return sorted((tuple(map(value, r)) for r in rows), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(db.sql(registry.SQL[name]).select(*columns).fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_whole_tables(spark, db):
    works = registry.QUERIES["works_for_every_topic"](spark, str(DATA))
    assert works.select("topic").distinct().count() == db.execute("SELECT count(DISTINCT l_partkey) FROM lineitem").fetchone()[0]
    texts = {r.conv_id: r.texts for r in registry.QUERIES["hydrate_long_blocks"](spark, str(DATA)).collect()}
    whole = db.execute("SELECT conv_id, string_agg(text, '|' ORDER BY turn) FROM conversations GROUP BY 1 HAVING max(length(text)) BETWEEN 101 AND 1500").fetchall()
    assert whole and all(texts[k] == t for k, t in whole)
