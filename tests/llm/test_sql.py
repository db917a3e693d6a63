"""The registered queries with SQL give DuckDB's rows."""

import os

import duckdb
import pytest

from talkmill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
