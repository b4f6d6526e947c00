"""The index of line hashes: batches over two sessions, in any order, against brute force; its plans."""

import random
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from braidlog.llm import linededup

LINES = [f"a line with number {k} that is long enough" for k in range(15)]


def texts(n=60):
    rng = random.Random(4)
    return {i: "\n".join(rng.sample(LINES, 3)) for i in rng.sample(range(1000), n)}


def expected(held, min_docs):
    return {(i, x) for x, ids in held.items() if len(ids) >= min_docs for i in ids if i != max(ids)}


@pytest.mark.parametrize("min_docs,hot", [(3, 200_000), (2, 10)])
def test_batches_of_two_sessions_drop_what_brute_force_drops(spark, min_docs, hot):
    docs = texts()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    hashed = linededup.hashed_lines(df).withColumn("batch", (F.col("id") * 7 % 5).cast("int")).cache()
    names = {(r.h1, r.h2): x for x in LINES for r in linededup.hashed_lines(spark.createDataFrame([(1, x)], "doc_id long, text string")).collect()}
    index, held, got = linededup.LineIndex(spark, fanout=2), {}, []
    for k in range(5):
        if k == 3:  # another session, which knows the path only
            index = linededup.LineIndex(spark.newSession(), index.path)
        batch = hashed.where(F.col("batch") == k).select("id", "h1", "h2")
        batch.write.mode("overwrite").parquet(f"{index.path}/in{k}")
        got += [(r.id, names[r.h1, r.h2]) for r in index.add(index.spark.read.parquet(f"{index.path}/in{k}"), min_docs, hot).collect()]
        for i, t in docs.items():
            if i * 7 % 5 == k:
                for x in t.split("\n"):
                    held.setdefault(x, []).append(i)
        assert len(got) == len(set(got)) and set(got) >= expected(held, min_docs)
    assert set(got) == expected(held, min_docs) and len(index.runs()) < 5
    total = sum(r["n"] for run in index.runs() for r in index.run(run).agg(F.sum("n").alias("n")).collect())
    assert total == sum(map(len, held.values()))
    index.remove()


def test_a_batch_meets_the_runs_without_a_shuffle(spark):
    df = spark.createDataFrame(list(texts(30).items()), "doc_id long, text string")
    hashed = linededup.hashed_lines(df)
    index = linededup.LineIndex(spark, fanout=9)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in range(3):
            index.add(hashed.where(F.col("id") % 3 == k)).count()
        with index._planned(), redirect_stdout(StringIO()) as out:
            index.decided(index.runs()[-1]).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.getvalue().count("SortMergeJoin") == 2 and "Exchange" not in out.getvalue()


def test_odd_rows_keep_their_columns(spark):
    line = LINES[0]
    rows = [(1, f"{line}\nx", "k", 1), (1, line, "k", 2), (2, line.upper() + " ", "k", 3), (3, line, "k", 4), (None, line, "k", 5), (4, None, "k", 6), (5, "", "k", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_lines long")
    got = {r.n_lines: (r.kept, r["__lines"].kept, r["__lines"].n_lines, r["__lines"].n_dropped) for r in linededup.cleaned(df).collect()}
    assert got == {1: ("k", "x", 2, 1), 2: ("k", "", 1, 1), 3: ("k", "", 1, 1), 4: ("k", line, 1, 0), 5: ("k", line, 1, 0), 6: ("k", "", 1, 0), 7: ("k", "", 1, 0)}
    assert linededup.cleaned(df.limit(0)).collect() == []
