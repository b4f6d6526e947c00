"""The corpus queries that SQL can express against that SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from braidlog.llm import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want, got = db.sql(Q.SQL[name]), Q.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
