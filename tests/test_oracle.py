"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from scorelens.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, (tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()))) == got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    assert not catalog.QUERIES[name](spark, DATA).isEmpty()
