"""What plans send through the driver, move and keep, where only large tables would show it."""

import pytest
from pyspark.sql import DataFrame

import braidlog.queries as Q
from braidlog.storage import cut

DIR = "/root/testdata/sf0.001"


def planned(df: DataFrame) -> str:
    """The plan before Spark has counted anything."""
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["obj_id", "get_path_index"])
def test_no_join_is_broadcast_by_an_estimate_from_compressed_files(spark, name):
    assert "BroadcastHashJoin" not in planned(Q.QUERIES[name](spark, DIR))


def test_a_cut_keeps_no_estimate(spark):
    log = cut(Q._nested(spark, DIR))
    assert int(log._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 1 << 60
    assert log.count() and log.schema == Q._nested(spark, DIR).schema


def documents(spark) -> int:
    return spark.read.parquet(f"{DIR}/documents.parquet").count()


@pytest.mark.parametrize("name", ["text_content", "text_length", "text_at", "patches_splice"])
def test_no_character_is_a_row(spark, name):
    assert "posexplode" not in planned(Q.QUERIES[name](spark, DIR))


@pytest.mark.parametrize("name", ["text_splice", "patches_delete_then_text", "json_export_text"])
def test_no_character_is_kept_as_a_row(spark, monkeypatch, name):
    from braidlog.functions import json as js

    rows = []

    def spy(df):
        rows.append((kept := cut(df)).count())
        return kept

    monkeypatch.setattr(Q, "cut", spy)
    monkeypatch.setattr(js, "cut", spy)
    Q.QUERIES[name](spark, DIR).count()
    assert rows and max(rows) <= 10 * documents(spark)


def test_deletes_are_shuffled_once_for_a_length(spark):
    """Deletes, runs and counts have a shuffle each."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = Q.QUERIES["text_length"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning") == 3
