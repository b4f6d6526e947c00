"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark in three steps. Each input batch counts its bigrams and
emits one packed row per model shard; a shard merges its rows, writes sorted
hash arrays and emits packed per-word statistics; a word shard merges those
and writes the unigram arrays. Only packed counts are shuffled, never tokens.
The arrays lie in the shared folder as plain ``.npy`` files; scoring workers
memory-map them and look up sorted hashes, so a worker's own memory holds one
batch of texts whatever the model's size.

The order is two. The bigram model projects to 3.6 times the input on disk of
the four allowed; check_s has 18.9 million distinct trigrams beside 12.1 million
distinct bigrams, so a third order is estimated, not measured, to exceed it.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import work_dir

#: Bytes of training text for each shard of the model, about.
SHARD_BYTES = 24_000_000
#: Hashes of the end token (counted as a token) and of the start (context only).
END, START = 1, 2
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, split at ASCII white space), then the end token."""
    import xxhash

    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def mix(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a bigram."""
    x = (u * _M1) ^ (v + _M2)
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The shard of a hash: its top bits, so shards in order are sorted throughout."""
    return (h >> np.uint64(63 - bits)).astype(np.int64) >> 1 if bits else np.zeros(len(h), np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + a.tobytes() for a in arrays), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(blob), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at:at + 8], "little"), np.dtype(raw[at + 8:at + 12].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the sums of each value over them."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return (k[first], *(np.add.reduceat(v[order].astype(np.int64), first) for v in values))


def _bigrams(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct bigrams by first, then second hash, with summed counts."""
    if not len(u):
        return u, v, c
    order = np.lexsort((v, u))
    u, v, c = u[order], v[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
    return u[first], v[first], np.add.reduceat(c.astype(np.int64), first)


def _small(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint8 if not len(c) or c.max() < 256 else np.uint32 if c.max() < 1 << 32 else np.int64)


class _Store:
    """Files of a model in a folder that all machines have mounted; other file systems can't be mapped and are refused."""

    def __init__(self, uri: str):
        if not uri.startswith("file:") and "://" in uri:
            raise ValueError(f"the model is memory-mapped, so the shared folder must be mounted on all machines: {uri}")
        self.local = "/" + uri.removeprefix("file:").lstrip("/")

    def put(self, name: str, array: np.ndarray) -> None:
        """Write whole or not at all, so a task may be tried again."""
        os.makedirs(self.local, exist_ok=True)
        fd, part = tempfile.mkstemp(dir=self.local)
        with os.fdopen(fd, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{self.local}/{name}.npy")

    def get(self, name: str) -> np.ndarray:
        return np.load(f"{self.local}/{name}.npy", mmap_mode="r")


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few numbers that belong to the whole corpus.

    ``tokens`` N, ``types`` V, ``bigrams`` distinct bigrams; ``d2`` and ``d1``
    are the discounts of counts 1, 2 and 3 or more for bigrams and for
    continuation counts; ``floor`` is the share left to the uniform distribution.
    """

    path: str
    bits: int
    tokens: int
    types: int
    bigrams: int
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    floor: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items counted 1, 2, 3 and 4 times.

    Where a needed number is zero (tiny corpora), half of the count's size at
    most is taken, so every discount stays between zero and its count.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def train(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES, path: str | None = None) -> Model:
    """Count ``docs`` and write the model's arrays into the shared folder.

    Every row counts, repeated ones too; a null text is an empty text: its end
    token only. No rows give an empty model. The number of shards follows the
    text's size, so a shard's arrays fit in a task at any size of the input,
    and bigrams are dealt by their own hash: a frequent word is in all shards.
    """
    spark = docs.sparkSession
    path = path or work_dir(spark, "lm")
    _Store(path)  # refused before any job runs
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bits = max(0, int(size // shard_bytes)).bit_length()
    blob = "shard int, blob binary"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [token_hashes(t) for t in b.iloc[:, 0]]
            if not hashes:
                continue
            v = np.concatenate(hashes)
            u = np.empty_like(v)
            u[1:] = v[:-1]
            u[np.cumsum([0, *map(len, hashes[:-1])])] = START
            u, v, c = _bigrams(u, v, np.ones(len(v), np.int64))
            s = shard_of(mix(u, v), bits)
            order = np.argsort(s, kind="stable")
            cuts = np.searchsorted(s[order], np.arange((1 << bits) + 1))
            rows = []
            for k in range(1 << bits):
                own = order[cuts[k]:cuts[k + 1]]
                if len(own):
                    first, n = np.unique(u[own], return_counts=True)
                    rows.append((k, _pack(first, _small(n), v[own], _small(c[own]))))
            yield pd.DataFrame(rows, columns=["shard", "blob"])

    def merge_bigrams(g: pd.DataFrame) -> pd.DataFrame:
        shard = int(g["shard"].iloc[0])
        parts = [_unpack(x) for x in g["blob"]]
        u = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        v, c = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        u, v, c = _bigrams(u, v, c)
        key = mix(u, v)
        order = np.argsort(key)
        store = _Store(path)
        store.put(f"b{shard}-key", key[order])
        store.put(f"b{shard}-c", _small(c[order]))
        one, two = (c == 1).astype(np.int64), (c == 2).astype(np.int64)
        # by word as a context: tokens after it, followers seen once, twice, oftener; as a follower: tokens, contexts
        a = _sums(u, c, one, two, 1 - one - two)
        b = _sums(v, c, np.ones(len(v), np.int64))
        zero = np.zeros
        words = np.concatenate([a[0], b[0]])
        n = len(a[0]), len(b[0])
        cols = [np.concatenate([x, zero(n[1], np.int64)]) for x in a[1:]] + [np.concatenate([zero(n[0], np.int64), x]) for x in b[1:]]
        words, *cols = _sums(words, *cols)
        s = shard_of(words, bits)
        at = np.searchsorted(s, np.arange((1 << bits) + 1))
        rows = [(k, _pack(words[x:y], *(_small(q[x:y]) for q in cols)), 0, 0, 0, 0, 0)
                for k, (x, y) in enumerate(zip(at, at[1:])) if y > x]
        rows.append((-1 - shard, None, len(c), *(int((c == i).sum()) for i in (1, 2, 3, 4))))
        return pd.DataFrame(rows, columns=["shard", "blob", "n", "n1", "n2", "n3", "n4"])

    def merge_words(g: pd.DataFrame) -> pd.DataFrame:
        shard = int(g["shard"].iloc[0])
        if shard < 0:  # the counts of counts of one bigram shard
            return g.drop(columns=["shard", "blob"]).assign(kind="bigrams", tokens=0)
        parts = [_unpack(x) for x in g["blob"]]
        words, after, f1, f2, f3, c, cont = _sums(*(np.concatenate([p[i] for p in parts]) for i in range(7)))
        store = _Store(path)
        for name, x in (("key", words), ("after", after), ("f1", f1), ("f2", f2), ("f3", f3), ("c", c), ("cont", cont)):
            store.put(f"w{shard}-{name}", x if name == "key" else _small(x))
        return pd.DataFrame([("words", int((c > 0).sum()), *(int((cont == i).sum()) for i in (1, 2, 3, 4)), int(c.sum()))],
                            columns=["kind", "n", "n1", "n2", "n3", "n4", "tokens"])

    numbers = "n long, n1 long, n2 long, n3 long, n4 long"
    totals = {r["kind"]: r for r in
              docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, blob)
              .groupBy("shard").applyInPandas(merge_bigrams, f"{blob}, {numbers}")
              .groupBy("shard").applyInPandas(merge_words, f"kind string, {numbers}, tokens long")
              .groupBy("kind").agg(*(F.sum(x).alias(x) for x in ("n", "n1", "n2", "n3", "n4", "tokens"))).collect()}
    if "words" not in totals:
        return Model(path, bits, 0, 0, 0, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 1.0)
    w, b = totals["words"], totals["bigrams"]
    d1 = discounts([w["n1"], w["n2"], w["n3"], w["n4"]])
    more = w["n"] - w["n1"] - w["n2"]
    floor = (d1[0] * w["n1"] + d1[1] * w["n2"] + d1[2] * more) / b["n"]
    return Model(path, bits, w["tokens"], w["n"], b["n"], discounts([b["n1"], b["n2"], b["n3"], b["n4"]]), d1, floor)


class _Scorer:
    def __init__(self, m: Model):
        self.m, self.store, self.open = m, _Store(m.path), {}

    def column(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            try:
                self.open[name] = self.store.get(name)
            except FileNotFoundError:  # a shard that got no rows
                self.open[name] = None
        return self.open[name]

    def find(self, kind: str, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """Values of sorted distinct ``keys``; zero where a key is not in the model."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        s = shard_of(keys, self.m.bits)
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else []
        for x, y in zip(at, at[1:]):
            held = self.column(f"{kind}{s[x]}-key")
            if held is None or not len(held):
                continue
            i = np.minimum(np.searchsorted(held, keys[x:y]), len(held) - 1)
            hit = np.flatnonzero(held[i] == keys[x:y])
            for o, name in zip(out, columns):
                o[x + hit] = self.column(f"{kind}{s[x]}-{name}")[i[hit]]
        return out

    def score(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of each text: known tokens, add-one score, Kneser-Ney score."""
        m = self.m
        v = np.concatenate(hashes)
        starts = np.cumsum([0, *map(len, hashes[:-1])])
        u = np.empty_like(v)
        u[1:] = v[:-1]
        u[starts] = START
        words, back = np.unique(np.concatenate([v, u]), return_inverse=True)
        c, cont, after, f1, f2, f3 = self.find("w", words, ("c", "cont", "after", "f1", "f2", "f3"))
        iv, iu = back[:len(v)], back[len(v):]
        base = np.log10((c + 1) / (m.tokens + m.types + 1))
        cut1 = np.array([0.0, *m.d1])[np.minimum(cont, 3)]
        p1 = (cont - cut1) / max(m.bigrams, 1) + m.floor / (m.types + 1)
        gamma = np.where(after > 0, (m.d2[0] * f1 + m.d2[1] * f2 + m.d2[2] * f3) / np.maximum(after, 1), 1.0)
        pairs, pair = np.unique(mix(u, v), return_inverse=True)
        (c2,) = self.find("b", pairs, ("c",))
        c2 = c2[pair]
        seen = np.maximum(after[iu], 1)
        p = np.maximum(c2 - np.array([0.0, *m.d2])[np.minimum(c2, 3)], 0) / seen + gamma[iu] * p1[iv]
        add = lambda x: np.add.reduceat(x, starts)
        return add((c[iv] > 0).astype(np.int64)), add(base[iv]), add(np.log10(p))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, n_known, train_tokens, base_score, score)``, one row per row.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the
    interpolated modified Kneser-Ney log10 probability of the text; unknown
    words share the uniform part. Perplexity is ``10 ** (-score / n_tokens)``.
    A null or empty text has one token, the end.
    """
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
                        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for b in batches:
            if len(b):
                hashes = [token_hashes(t) for t in b.iloc[:, 1]]
                known, base, kn = scorer.score(hashes)
                yield pd.DataFrame({id_col: b.iloc[:, 0], "n_tokens": [len(h) for h in hashes], "n_known": known,
                                    "train_tokens": model.tokens, "base_score": base, "score": kn})

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInPandas(run, out)


def in_fold(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold that is held out; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)) == fold
