"""The pipeline's stages on rows with null and repeated ids."""

import pytest

import corpus_pipeline
from braidlog.llm import bpe, mixing, quality

SCHEMA = "doc_id long, text string, source string, n_chars long"
LINE = "a line that is long enough to count"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t)) for i, t, s in rows], SCHEMA)


def test_quality_judges_rows_not_ids(spark, monkeypatch):
    good, bad = [" ".join(f"w{(k * j) % 97}" for j in range(1, 30)) for k in range(1, 61)], [f"vile vile{k % 7} dirt" for k in range(60)]
    rows = [*((k, t, "a") for k, t in enumerate(good)), *((100 + k, t, "a") for k, t in enumerate(bad))]
    odd = [(None, good[3], "b"), (None, bad[3], "b"), (7, bad[5], "b"), (101, good[5], "b")]
    labels = spark.createDataFrame([(i, i < 100) for i, _, _ in rows if i not in (7, 101)], "doc_id long, good boolean")
    monkeypatch.setattr(corpus_pipeline, "good_labels", lambda *_: labels)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, frame(spark, [*rows, *odd]), "").collect()}
    assert {(None, good[3]), (101, good[5]), (7, good[7])} <= got
    assert not {(None, bad[3]), (7, bad[5]), (101, bad[1])} & got
    assert hasattr(quality, "score")


def test_line_stage_keeps_each_text_of_an_id(spark):
    rows = [(1, f"one\n{LINE}", "a"), (1, f"other\n{LINE}", "a"), (1, "third text", "a"), (2, f"two\n{LINE}", "a"), (3, f"three\n{LINE}", "a"), (None, f"none\n{LINE}", "a")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.line_stage(spark, frame(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(1, "one"), (1, "other"), (1, "third text"), (2, "two"), (3, f"three\n{LINE}"), (None, f"none\n{LINE}")], key=str)


def test_neardup_keeps_one_row_of_each_group(spark):
    rows = [(1, "same words", "a"), (1, "same words", "a"), (1, "unlike text", "a"), (None, "lonely", "a"), (None, "lonely", "a"), (None, "same words", "a"), (4, "lonely two", "a")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.neardup_stage(spark, frame(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(1, "same words"), (1, "unlike text"), (None, "lonely"), (4, "lonely two")], key=str)


@pytest.mark.parametrize("times", [1, 2])
def test_mix_stage_emits_what_the_mix_takes(spark, times):
    rows = [(k % 9 if k % 5 else None, f"text {k} " * (1 + k % 4), "abc"[k % 3]) for k in range(90)] * times
    df = frame(spark, rows)
    out = [r.text for r in corpus_pipeline.mix_stage(spark, df, "").collect()]
    words = {r.target for r in mixing.mix(df, "doc_id").collect()}
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(len(t.split()) for t in out) - total) <= 40 and words and max(map(out.count, out)) <= 3 * times


def workers(df):
    """Python steps of each stage's plan: a task holds a worker for every one."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.count("EvalPython") + part.count("InPandas") for part in plan.split("Exchange")]


def test_a_task_of_the_line_stage_has_one_python_worker(spark):
    rows = [(k, f"text {k}\n{LINE}", "a") for k in range(4)]
    assert max(workers(corpus_pipeline.line_stage(spark, frame(spark, rows), ""))) == 1


def test_a_task_of_the_token_stage_has_one_python_worker(spark):
    rows = [(1, "a few words", "a"), (1, "a few words", "a"), (None, "", "a"), (2, None, "a"), (3, "many words\u00e9 " * 4000, "a")]
    df = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], SCHEMA)
    out = corpus_pipeline.bpe_stage(spark, df, "")
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    path, pattern = corpus_pipeline.tokenizer()
    told = bpe.digests(bpe.encode(df, path, pattern), path, pattern)
    assert sorted(map(tuple, out.drop("ids").collect()), key=str) == sorted(map(tuple, told.collect()), key=str)
