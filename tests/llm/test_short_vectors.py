"""Embedding links of short vectors."""

import numpy as np
import pytest

from braidlog.llm import embeddings


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 8, 12, 16, 24, 32])
def test_recall_at_small_dimensions(dim):
    rng = np.random.default_rng(dim)
    a, n = rng.standard_normal((2, 500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a
    if dim > 1:
        n -= (n * a).sum(1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(0.19) * n / np.linalg.norm(n, axis=1, keepdims=True)
    sets = []
    for x in (a, b):
        row, f = embeddings.list_decode(x, embeddings.codes(dim), embeddings.cap_for(dim))
        assert len(row) < 3000 * len(x)
        sets.append(np.split(f, np.searchsorted(row, np.arange(1, 500))))
    assert np.mean([np.intersect1d(x, y).size > 0 for x, y in zip(*sets)]) > 0.93


def test_links_of_eight_components(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((30, 8))
    m = np.concatenate([v, v + 0.1 * rng.standard_normal((30, 8))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    assert all(got[k] <= s[k].sum() for k in range(60)) and sum(got.values()) >= 0.95 * s.sum()
