"""The queries that SQL can express against their SQL, on whole tables."""

import duckdb
import pytest

from scorelens.llm import queries

TABLES = "documents embeddings labels".split()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name, sf):
    data = f"/root/testdata/{sf}"
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert sorted(repr(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns)) for r in want.fetchall()) == got
