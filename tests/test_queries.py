"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from factloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x for x in r))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", queries.queries())
def test_query_matches_sql(spark, small, duck, name):
    got = queries.queries()[name](spark, small).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert queries.queries().keys() == queries.oracle_sql().keys()
