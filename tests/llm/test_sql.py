"""The queries that SQL can express, against DuckDB on the small tables."""

import duckdb
import pytest

from factloom.llm import entries

TABLES = ("documents", "benchmark", "labels")


@pytest.mark.parametrize("name", entries.oracle_sql())
def test_query_matches_sql(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = c.sql(entries.oracle_sql()[name]).df()
    got = entries.queries()[name](spark, small).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_spans_of_secrets_are_whole_and_in_order(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in entries.queries()["op4_secrets"](spark, small).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
        for kind, a, b in spans:
            piece = docs[r["doc_id"]][int(a) : int(b)]
            assert piece and (kind != "hex" or set(piece) <= set("0123456789abcdef"))
