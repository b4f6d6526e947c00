"""Corpus operators: odd inputs for all of them, and brute force on small fixtures."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlog.llm import bpe, common, embeddings, fingerprints, licenses, linededup, lm, mixing, quality, simhash_dedup, urlfilter
from braidlog.llm.queries import tokenizer

PATH, PATTERN = tokenizer()
LONG = "lorem ipsum " * 9000 + "\n" + "x" * 70000
ROWS = [(1, "Released under the MIT License.\nA line that is long enough to count\nend", "en", "s1"), (2, None, None, None), (3, "", "de", "s2"),
        (4, LONG, "en", "s1"), (5, "A LINE that is long enough to count  \nGNU general public license, CC BY-NC", "fr", None), (5, "another text, same id", "fr", "s3"),
        (6, "\ta line that is long enough to count\n\n\n", "en", "s1"), (6, "\ta line that is long enough to count\n\n\n", "en", "s1"), (None, "no id here", "en", "s1"),
        (7, " \n ", "en", "s2"), (8, "Été \U0001f600 K", "fr", "s2")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in ("id", "h", "n", "key", "kept", "bucket", "size", "class", "part", "score", "fp", "ids")))


RUNS = {
    "bpe": lambda d: bpe.digests(bpe.encode(d, PATH, PATTERN), PATH, PATTERN),
    "license": lambda d: licenses.digest(licenses.scan(d)),
    "simhash": lambda d: simhash_dedup.near_duplicates(d, shingle=3),
    "mix": mixing.mix,
    "prints": fingerprints.report,
    "quality": lambda d: quality.resample(d, d.select("doc_id", (F.col("doc_id") % 2 == 0).alias("good"))),
    "lines": linededup.dedup,
    "lm": lambda d: lm.score(d, lm.train(d)),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_and_empty_tables(docs, name):
    assert len(RUNS[name](docs).collect()) == len(ROWS)
    assert RUNS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (50, 20), (8, 3)])
def test_bpe_equals_the_library(spark, chunk, overlap):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "'ll", "'", "1", "é", "!?", "word", "\t", "　"]) for _ in range(300)) for _ in range(20)] + [LONG[:3000], "y" * 900, " " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df, PATH, PATTERN, chunk=chunk, overlap=overlap).collect()}
    assert got == {k: enc.encode_ordinary(t) for k, t in enumerate(texts)}


def components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 7 for k in range(7, 40)}


@pytest.mark.parametrize("bucket", [1, 64])
def test_simhash_links_equal_brute_force(spark, bucket):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))) & (1 << 64) - 1 for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.component for r in common.connected_components(simhash_dedup.links(df, bucket), "a", "b").collect()}
    want = components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {x: got.get(x, x) for x in signed} == want


def test_golay_keys_cover_two_errors():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 5000, dtype=np.int64)
    b = a.copy()
    for _ in range(2):
        b ^= np.int64(1) << rng.integers(0, 63, 5000)
    assert all(np.intersect1d(x, y).size for x, y in zip(simhash_dedup.golay_keys(a), simhash_dedup.golay_keys(b)))


@pytest.mark.parametrize("block_rows", [16, 512])
def test_embeddings_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 64))
    near = np.concatenate([v[k] + 0.1 * rng.standard_normal((5 if k else 60, 64)) for k in range(20)])
    m = np.concatenate([v, near, v[:5], 2 * v[:2]]).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(m)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0]), (904, []), (905, [None] * 64)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=block_rows).collect()}
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    found = sum(got[k].n_links for k in range(len(m)))
    assert all(got[k].n_links <= s[k].sum() for k in range(len(m))) and found >= 0.95 * s.sum()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (900, 901, 902, 903, 904, 905))


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.standard_normal((1000, 64))
    n -= (n * a).sum(1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(0.19) * n / np.linalg.norm(n, axis=1, keepdims=True)
    sets = []
    for x in (a, b):
        row, f = embeddings.list_decode(x, embeddings.codes(64))
        sets.append(np.split(f, np.searchsorted(row, np.arange(1, 1000))))
    assert np.mean([np.intersect1d(x, y).size > 0 for x, y in zip(*sets)]) > 0.93


def test_language_model_refuses_a_folder_that_is_not_mounted(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="mounted"):
        lm.train(docs, path="hdfs://there/lm")


def test_language_model_sums_to_one_and_equals_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(30))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(df, shard_bytes=200)
    got = {r.doc_id: r for r in lm.score(df, model).collect()}
    c, pairs = Counter(), Counter()
    for t in texts:
        k = [*t.split(), "</s>"]
        c.update(k)
        pairs.update(zip(["<s>", *k], k))
    cont, after = Counter(v for _, v in pairs), Counter()
    for (u, _), n in pairs.items():
        after[u] += n
    d2, d1 = (lm.discounts([Counter(x.values())[i] for i in (1, 2, 3, 4)]) for x in (pairs, cont))
    floor = sum(d1[min(n, 3) - 1] for n in cont.values()) / len(pairs)

    def p(u, v):
        low = ((cont[v] - d1[min(cont[v], 3) - 1]) if cont[v] else 0) / len(pairs) + floor / (len(c) + 1)
        n = pairs.get((u, v), 0)
        gamma = sum(d2[min(x, 3) - 1] for (a, _), x in pairs.items() if a == u) / after[u]
        return (n - d2[min(n, 3) - 1] if n else 0) / after[u] + gamma * low

    assert abs(sum(p("a", v) for v in [*c, "unknown"]) - 1) < 1e-9
    for i, t in enumerate(texts[:20]):
        k = [*t.split(), "</s>"]
        assert got[i].score == pytest.approx(sum(math.log10(p(u, v)) for u, v in zip(["<s>", *k], k)))
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (sum(c.values()) + len(c) + 1)) for x in k))


def test_fold_is_crc32(spark):
    got = {r.doc_id: r.f for r in spark.range(200).select(F.col("id").alias("doc_id"), lm.in_fold("id").alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(200)}


def test_licenses_with_gaps(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and its associated documentation files"
    rows = [(1, mit), (2, "apache license apache license the cc by"), (3, "this is about a license")]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.8 <= got[1].score < 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 5, "apache,cc-by") and got[3].labels == ""


def test_fingerprint_search_equals_brute_force(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(40)]
    fps = set(base) | {b ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for b in base} | {b ^ 0b11111 for b in base}
    low = lambda x: (x & (1 << 64) - 1) - (1 << 64 if x >> 63 & 1 else 0)
    df = spark.createDataFrame([(low(x), low(x >> 64)) for x in fps], "f0 long, f1 long")
    got = fingerprints.search(df, df).collect()
    assert len(got) == len(set(got)) == sum((a ^ b).bit_count() <= 3 for a in fps for b in fps)


def test_neighbours_across_buckets(spark):
    ids = [*range(0, 50), *range(10**6, 10**6 + 300, 3), -5]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.id: r.next_text for r in fingerprints.neighbours(df, "doc_id", "text", rows=7).where("not ghost").collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_mix_reaches_targets_and_caps(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "tiny" if i % 50 == 0 else rng.choice("abc")) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    src = {i: s for i, _, s in rows}
    for s in {*src.values()}:
        mine = [r for r in got if src[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 120 and max(r.copies for r in mine) <= 3
    assert sum(r.target for r in {src[r.doc_id]: r for r in got}.values()) == pytest.approx(sum(r.size for r in got))


def test_line_index_compacts_and_agrees(spark):
    lines = [f"a line with number {k} that is long" for k in range(12)]
    rng = random.Random(6)
    texts = {i: "\n".join(rng.sample(lines, 4)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held = {x: sorted(i for i, t in texts.items() if x in t.split("\n")) for x in lines}
    want = {i: "\n".join(x for x in t.split("\n") if len(held[x]) < 3 or held[x][-1] == i) for i, t in texts.items()}
    for batches, fanout, hot in ((1, 3, 200_000), (5, 2, 12), (2, 3, 5)):
        assert {r.doc_id: r.kept for r in linededup.dedup(df, batches=batches, fanout=fanout, hot_lines=hot).collect()} == want


def test_url_rules_and_reputation(spark):
    urls = ["http://A.com/fr/x", "http://a.com/de/x?q", "https://www.example.org/es/1", "https://www.example.org/en/12", "https://x.org", None, "nourl", "http://b.net/x#y", "http://b.net:80?z"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert [got[i].rule for i in range(9)] == ["com/fr/", "com/de/", "example.org/es/", "example.org/en/1", None, None, None, None, None]
    assert [(got[i].host, got[i].path) for i in (0, 4, 5, 6, 7, 8)] == [("a.com", "/fr/x"), ("x.org", ""), ("", ""), ("", ""), ("b.net", "/x"), ("b.net:80", "")]
    labels = spark.createDataFrame([("good.net", True)] * 40 + [("bad.net", False)] * 40, "host string, good boolean")
    pages = spark.createDataFrame([(0, "http://good.net/"), (1, "http://bad.net/"), (2, "http://www.bad.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(pages, outcomes=labels).collect()} == {0: "allow", 1: "block", 2: "block"}


def test_classifier_finds_bad_words_on_held_out_rows(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*rng.choices(words, k=60), *(["vile"] if i % 4 == 0 else [])]), i % 4 != 0) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    got = quality.resample(df, df.where("doc_id < 400").select("doc_id", "good")).join(df, "doc_id").where("doc_id >= 400")
    assert got.where("kept <> good").count() <= 8


def test_kth_largest(spark):
    rng = random.Random(7)
    xs = [rng.randrange(1 << 36) for _ in range(500)] + [5] * 20
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    assert [quality.kth_largest(df, "x", k) for k in (1, 100, 515, 521)] == [*(sorted(xs, reverse=True)[k - 1] for k in (1, 100, 515)), None]
