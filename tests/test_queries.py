"""Every core query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import braidlog.queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, db, name):
    want = db.sql(Q.SQL[name])
    got = Q.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key)
    assert a == sorted(want.fetchall(), key=key)


def test_save_load_keeps_every_operation(spark):
    from braidlog.sources.adapters import map_log

    r = Q.save_load(spark, DIR)
    ops = map_log(spark, DIR).groupBy("doc_id").count()
    assert r.join(ops, "doc_id").where("n_ops <> count").count() == 0 and r.count() == ops.count()
