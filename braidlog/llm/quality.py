"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are fitted: one of target text, the
rows labelled good, and one of raw text, all rows. A document's importance is
the log ratio of its probability under the two. Gumbel noise is added and the
k largest sums are taken, which samples k documents without replacement in
proportion to their importance. k is a share of the rows, by default the share
of good rows among the labelled ones.

A text's features are the distinct hash buckets of its words, of the byte
n-grams that begin and end them, and of whether it repeats words back to back.
A bucket is a Bernoulli event in a document. Its log ratio is shrunk towards
zero by pseudo documents, and ratios within ``FLAT`` of zero count as zero, so
a long text does not drift by many words of slight preference. Word pairs are
left out: on labelled rows held out, they cost clean documents and found no
more bad ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Hash buckets; labelled rows that are broadcast at most (more are joined by a
#: shuffle); pseudo documents; log ratios that count as none.
BUCKETS, MAX_LABELS, PSEUDO, FLAT = 1 << 22, 200_000, 3.0, 2.0
#: Scale of the noise: one samples in proportion to the importance.
TEMPERATURE = 1.0
#: Distinct words whose features a worker remembers.
MEMO = 100_000
SEED = 11


def word_features(word: bytes, buckets: int = BUCKETS) -> tuple[int, int, int, int]:
    """Buckets of a word, of its first four and five bytes (A-Z lower-cased), and of its last two as they are."""
    import xxhash

    low, digest = word.lower(), xxhash.xxh64_intdigest
    return digest(low) % buckets, digest(low[:4], 4) % buckets, digest(low[:5], 5) % buckets, digest(word[-2:], 2) % buckets


def repeats(words: list[bytes]) -> bool:
    """Whether over a twentieth of the words, three at least, repeat the one before (A-Z lower-cased)."""
    again = sum(map(bytes.__eq__, words, words[1:]))
    return again >= 3 and 20 * again > len(words)


def features(text: str | None, buckets: int = BUCKETS) -> set[int]:
    """Distinct buckets of a text's n-grams; a text without words has none."""
    words = (text or "").encode().split()
    out = {x for w in set(words) for x in word_features(w, buckets)}
    return out | {REPEATS % buckets} if repeats([w.lower() for w in words]) else out


#: The bucket of texts that repeat words back to back.
REPEATS = 3


@dataclass
class Model:
    """The weight of each bucket whose log ratio counts, the documents behind both models, and the good share of the labelled rows."""

    buckets: int
    weights: dict[int, float]
    target_docs: int
    raw_docs: int
    share: float
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def log_ratio(self, text: str | None) -> float:
        words, known, weights, own = (text or "").encode().split(), self.known, self.weights, set()
        for w in set(words):
            found = known.get(w)
            if found is None:
                if len(known) >= MEMO:
                    known.clear()
                found = tuple(x for x in word_features(w, self.buckets) if x in weights)
                if len(w) <= 64:
                    known[w] = found
            own.update(found)
        if REPEATS % self.buckets in weights and repeats([w.lower() for w in words]):
            own.add(REPEATS % self.buckets)
        return float(sum(weights[x] for x in sorted(own)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
        max_labels: int = MAX_LABELS, pseudo: float = PSEUDO, flat: float = FLAT) -> Model:
    """Fit the raw model on all rows of ``docs`` and the target model on those that ``labels`` ``(id_col, good boolean)`` calls good.

    All labelled rows count. Up to ``max_labels`` of them are broadcast; beyond,
    labels and texts are shuffled to meet. An id with several labels is good if
    all of them say so. Documents are counted whole and all. A task counts in two arrays
    of ``buckets`` and gives one row for each bucket it met. Counts are summed and
    weighed in Spark; only buckets with a clear ratio are collected, ``buckets`` at
    most. Null ids and null labels are ignored, rows without a label count as raw
    text. Where no row is good every ratio is zero and the share is one.
    """
    known = labels.where(F.col("good").isNotNull()).select(F.col(id_col).alias("id"), F.col("good").cast("int").alias("good"))
    known = known.groupBy("id").agg(F.min("good").alias("good"))
    known = F.broadcast(known) if labels.limit(max_labels + 1).count() <= max_labels else known.hint("merge")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id", "left").select("text", "good")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target, memo = np.zeros(buckets, np.int32), np.zeros(buckets, np.int32), {}
        for b in batches:
            for text, good in zip(b["text"], b["good"] == 1):
                words, own = (text or "").encode().split(), set()
                for w in set(words):
                    found = memo.get(w)
                    if found is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        found = word_features(w, buckets)
                        if len(w) <= 64:
                            memo[w] = found
                    own.update(found)
                if repeats([w.lower() for w in words]):
                    own.add(REPEATS % buckets)
                at = np.fromiter(own, np.int64, len(own))
                raw[at] += 1
                if good:
                    target[at] += 1
        at = np.flatnonzero(raw)
        for k in range(0, len(at), 100_000):
            part = at[k:k + 100_000]
            yield pd.DataFrame({"bucket": part.astype(np.int32), "raw": raw[part], "target": target[part]})

    n = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    good, every = n.get(1, 0), sum(n.values())
    if not good:
        return Model(buckets, {}, 0, every, 1.0)
    ratio = F.log((F.col("target") + pseudo) / (F.col("raw") * F.lit(good / every) + pseudo))
    got = (rows.mapInPandas(count, "bucket int, raw int, target int").groupBy("bucket")
           .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
           .select("bucket", ratio.alias("w")).where(F.abs("w") >= flat).toPandas())
    return Model(buckets, dict(zip(got["bucket"].tolist(), got["w"].tolist())), good, every, good / (good + n.get(0, 0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE,
          seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id_col, *carry, log_ratio, key)``: importance and its sum with the noise, one row per row.

    The noise is a function of seed, id and text, so a task that runs again
    draws it again. A text without words has ratio zero. ``carry`` names
    columns to keep beside; they may not be called like the result's others.
    """
    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        return texts.map(model.log_ratio, na_action=None).astype(float)

    text = F.col(text_col).cast("string")
    draw = F.xxhash64(F.lit(seed), F.col(id_col), text)
    uniform = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    gumbel = -F.log(-F.log(uniform))
    return (docs.select(F.col(id_col).alias("__id"), *carry, ratio(text).alias("log_ratio"), gumbel.alias("noise"))
            .select(F.col("__id").alias(id_col), *carry, "log_ratio", (F.col("log_ratio") + F.lit(temperature) * F.col("noise")).alias("key")))


def kth_largest(df: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest value of a long column in [0, 2**36); None if there are fewer.

    Radix selection: three rounds, each collecting at most 4096 counts.
    """
    prefix, left = 0, k
    for shift in (24, 12, 0):
        rows = (df.where(F.shiftright(col, shift + 12) == prefix).groupBy((F.shiftright(col, shift) % 4096).alias("digit"))
                .agg(F.count("*").alias("n")).collect())
        for r in sorted(rows, key=lambda r: -r["digit"]):
            if r["n"] >= left:
                prefix = (prefix << 12) + int(r["digit"])
                break
            left -= r["n"]
        else:
            return None
    return prefix


def select(scored: DataFrame, k: int, keys: DataFrame | None = None) -> DataFrame:
    """``scored`` with ``kept``: whether the row is among the k largest keys.

    Keys are compared to a resolution of 2**-16, and rows that tie with the
    k-th are kept. ``scored`` is read several times, or ``keys``, its column
    ``key``, instead; materialise them before.
    """
    fixed = F.floor((F.least(F.greatest("key", F.lit(-524288.0)), F.lit(524287.0)) + 524288.0) * 65536).cast("long")
    ranked = scored.withColumn("__rank", fixed)
    least = kth_largest(ranked if keys is None else keys.select(fixed.alias("__rank")), "__rank", k) if k > 0 else None
    kept = F.lit(k > 0) if least is None else F.col("__rank") >= least
    return ranked.withColumn("kept", kept).drop("__rank")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None,
             temperature: float = TEMPERATURE, key_col: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key_col, *carry, log_ratio, key, kept)``, one row per row of ``docs``: fit, score and take the k largest.

    k is ``share`` of the rows, rounded; by default the share of good rows among
    the labelled ones. ``key_col`` names the rows in the result, else ``id_col``.
    """
    key_col = key_col or id_col
    model = fit(docs, labels, id_col, text_col)
    scored = cut(score(docs, model, key_col, text_col, temperature, carry=carry))
    keys = cut(scored.select("key")) if carry else scored
    return select(scored, round((model.share if share is None else share) * keys.count()), keys)
