"""Corpus queries with SQL against DuckDB, over whole tables."""

import os

import duckdb
import pytest

from presetlake.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    df = queries.QUERIES[name](spark, SF)
    asked = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in asked.description)
    assert sorted(df.columns) == columns
    want = [dict(zip([c[0] for c in asked.description], r)) for r in asked.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[c] for c in columns) for r in want), key=repr)
