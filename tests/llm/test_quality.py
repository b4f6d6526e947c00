"""The classifier against a brute-force version, and the rates at which it samples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlog.llm import quality


def corpus(n=300):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*rng.choices(words, k=40), *(["vile"] if i % 4 == 0 else [])]), None if i % 3 == 0 else i % 4 != 0) for i in range(n)]
    return [*rows, (n, "", True), (n + 1, None, False), (None, "no id", True), (5, "w1 w1 w1 w1 w1", None), (5, "w1 w1 w1 w1 w1", None)]


def test_weights_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    labels = df.where("good is not null").select("doc_id", "good")
    got = quality.fit(df.repartition(3), labels, flat=0.5)
    good = {i: g for i, _, g in rows if g is not None and i is not None}
    raw, target, n = {}, {}, 0
    for i, text, _ in rows:
        n += good.get(i) is True
        for x in quality.features(text):
            raw[x] = raw.get(x, 0) + 1
            target[x] = target.get(x, 0) + (good.get(i) is True)
    want = {x: w for x in raw if abs(w := math.log((target[x] + 3) / (raw[x] * n / len(rows) + 3))) >= 0.5}
    assert got.weights.keys() == want.keys() and all(got.weights[x] == pytest.approx(want[x]) for x in want)
    assert (got.target_docs, got.raw_docs) == (n, len(rows)) and got.share == pytest.approx(n / sum(i in good for i, _, _ in rows))
    for _, text, _ in rows:
        assert got.log_ratio(text) == pytest.approx(sum(want.get(x, 0) for x in quality.features(text)))


def test_k_rows_are_kept_and_reruns_agree(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, good boolean")
    labels = df.where("good is not null").select("doc_id", "good")
    a, b = (sorted(map(tuple, quality.resample(df, labels, share=0.4).collect()), key=str) for _ in range(2))
    assert a == b and abs(sum(r[3] for r in a) - 0.4 * len(a)) <= 1
    assert min(r[2] for r in a if r[3]) >= max(r[2] for r in a if not r[3])


def test_inclusion_follows_importance(spark):
    """Of two kinds of rows whose importances are as 1 to 5, a small sample takes the second about five times as often."""
    m = quality.Model(1 << 22, {quality.word_features(b"rich")[0]: math.log(5)}, 1, 2, 0.5)
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "rich").otherwise("poor").alias("text"))
    kept = quality.select(quality.score(df, m).cache(), 2000).where("kept").collect()
    rich = sum(r.doc_id % 2 == 0 for r in kept)
    assert len(kept) == 2000 and 4.2 < rich / (len(kept) - rich) < 6


def test_no_good_rows_keep_all(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, False), (2, None)], "doc_id long, good boolean")
    assert [r.kept for r in quality.resample(df, none).collect()] == [True, True]
    assert quality.resample(df.limit(0), none).collect() == []
    assert np.isfinite([r.key for r in quality.resample(df, none).collect()]).all()


def test_the_bound_on_broadcast_labels_leaves_none_out(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, good boolean")
    labels = df.where("good is not null").select("doc_id", "good")
    whole, shuffled = (quality.fit(df, labels, flat=0.5, max_labels=n) for n in (1000, 3))
    assert whole.target_docs > 3 and shuffled == whole
