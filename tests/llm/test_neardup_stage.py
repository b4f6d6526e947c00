"""The near-dedup stage on planted pairs, against brute force over shingle sets."""

import random

import pytest

import corpus_pipeline
from braidlog.llm import simhash_dedup


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def planted():
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([60, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [*texts, texts[0].upper(), "", " ", "one two", "one two three"]


def smallest(texts, threshold):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_stage_keeps_one_of_each_group_at_jaccard(spark):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = smallest(texts, 0.8)
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df, similarity=0.8).collect()}
    assert got == want
    assert {r.doc_id for r in corpus_pipeline.neardup_stage(spark, df, "").collect()} == set(want.values())


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(1, "a b c d e f g")][:n], "doc_id long, text string")
    assert len(simhash_dedup.near_duplicates(df, similarity=0.8).collect()) == n


def test_a_crowd_of_edited_copies_in_blocks(spark, monkeypatch):
    """Copies of one text of which most are not near the smallest: all pairs under a key, over several blocks."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash_dedup, "COMPARED", 16)
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df, similarity=0.8).collect()}
    assert got == smallest(texts, 0.8) and 1 < len(set(got.values())) < len(texts)
