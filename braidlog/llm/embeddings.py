"""Embedding near-dedup by spherical-cap filters.

A filter is a direction: the concatenation of one code word from each of a few
random spherical codes, one code per block of dimensions (a random product
code). A vector passes every filter whose direction it exceeds by a threshold;
list decoding finds them block by block without visiting all directions.
Vectors meet in the filters that both pass and are verified exactly there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

#: Cosine from which vectors are linked.
THRESHOLD = 0.9
#: Rotations, blocks and code words per block of the product codes, and the cap:
#: standard deviations of a random direction's inner product that a filter asks
#: for. A vector passes about 40 of the 196,608 filters. Each rotation has codes
#: of its own, which evens out how many filters a vector passes. At a cosine of
#: exactly 0.9, 97 of 100 random pairs share a filter, at 0.95 all but a few.
ROTATIONS, BLOCKS, WORDS, CAP = 48, 4, 8, 3.4
#: Share of random pairs at the threshold that the filters of short vectors must find.
RECALL = 0.97
#: Vectors compared at once; a fuller filter is compared in pairs of blocks.
BLOCK_ROWS = 512
SEED = 20


@lru_cache(maxsize=4)
def codes(dim: int, rotations: int = ROTATIONS, blocks: int = BLOCKS, words: int = WORDS, seed: int = SEED) -> list[tuple]:
    """Random rotations, each with random unit code words for every block of dimensions."""
    rng = np.random.default_rng([seed, dim])
    # a block of one component would repeat two code words
    blocks = max(1, min(blocks, dim // 2))
    out = []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        code = []
        for part in np.array_split(np.arange(dim), blocks):
            c = rng.standard_normal((words, len(part)))
            code.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12))
        out.append((turn, code))
    return out


def list_decode(unit: np.ndarray, turned: list[tuple], cap: float = CAP) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` of every filter that a unit vector exceeds, in order.

    The code words of the first and of the second half of the blocks are
    summed to two lists; only sums of the first that the second list's best
    can lift over the threshold are extended.
    """
    dim, blocks, words = unit.shape[1], len(turned[0][1]), len(turned[0][1][0])
    need = cap * np.sqrt(blocks / dim)
    parts, mid = np.array_split(np.arange(dim), blocks), blocks // 2

    def half(xs: list[np.ndarray]) -> np.ndarray:
        s = np.zeros((len(unit), 1))
        for x in xs:
            s = (s[:, :, None] + x[:, None, :]).reshape(len(s), -1)
        return s

    rows, found = [], []
    for k, (turn, code) in enumerate(turned):
        v = unit @ turn
        dots = [v[:, p] @ c.T for p, c in zip(parts, code)]
        left, right = half(dots[:mid]), half(dots[mid:])
        i, a = np.nonzero(left >= need - right.max(1, keepdims=True))
        x, b = np.nonzero(right[i] + left[i, a][:, None] >= need)
        rows.append(i[x])
        found.append((k * words**mid + a[x]) * words ** (blocks - mid) + b)
    row, ids = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((ids, row))
    return row[order], ids[order]


@lru_cache(maxsize=256)
def cap_for(dim: int, threshold: float = THRESHOLD, cap: float = CAP, rotations: int = ROTATIONS, blocks: int = BLOCKS,
            words: int = WORDS, seed: int = SEED) -> float:
    """The deviations that vectors of ``dim`` components must exceed: ``cap`` from 64 on, less for shorter ones.

    A filter's direction has norm sqrt(blocks) at most, so a fixed number of
    deviations is more than short vectors can reach. For them the largest step
    is taken at which ``RECALL`` of random pairs at the threshold share a filter.
    """
    if dim >= 64 or dim < 2:
        return cap if dim >= 64 else min(cap, 0.5)
    rng, turned = np.random.default_rng([seed, dim, 1]), codes(dim, rotations, blocks, words, seed)
    a, n = rng.standard_normal((2, 300, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n -= (n * a).sum(1, keepdims=True) * a
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * n / np.linalg.norm(n, axis=1, keepdims=True)
    # no direction passes beyond sqrt(dim) deviations
    for step in np.arange(min(cap, np.sqrt(dim)), 0, -0.1):
        sets = []
        for x in (a, b):
            row, found = list_decode(x, turned, step)
            sets.append(row.astype(np.int64) << 32 | found)
        if len(np.unique(np.intersect1d(*sets) >> 32)) >= RECALL * len(a):
            return float(step)
    return 0.0


def units(v: pd.Series) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that no square overflows."""
    unit = np.array(v.tolist(), dtype=np.float64)
    unit /= np.abs(unit).max(1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _components(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name that each row reaches through a square boolean matrix."""
    label = names.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            return label
        label = new


def compare(a: dict, b: dict | None, filter_id: int, threshold: float) -> pd.DataFrame | None:
    """Links within one block (``b`` None) or between two, met in ``filter_id``.

    A pair that also meets in a smaller filter is counted there. Returns each
    linked vector with the number of vectors it is linked to and the smallest
    representative it reaches here: no pair leaves this function.
    """
    both = a if b is None else {k: np.concatenate([a[k], b[k]]) if k != "filters" else a[k] + b[k] for k in a}
    n, split = len(both["id"]), len(a["id"])
    near = both["unit"] @ both["unit"].T >= threshold
    np.fill_diagonal(near, False)
    if b is not None:
        near[:split, :split] = False
        near[split:, split:] = False
    rows = np.flatnonzero(near.any(1))
    if not len(rows):
        return None
    near = near[np.ix_(rows, rows)]
    earlier = [f[f < filter_id] for f in (both["filters"][i] for i in rows)]
    ids, at = np.unique(np.concatenate(earlier), return_inverse=True)
    member = np.zeros((len(rows), len(ids)), np.float32)
    member[np.repeat(np.arange(len(rows)), [len(x) for x in earlier]), at] = 1
    near &= member @ member.T == 0
    links = near @ both["copies"][rows]
    hit = np.flatnonzero(links)
    if not len(hit):
        return None
    label = _components(near, both["id"][rows])
    return pd.DataFrame({"rep": both["id"][rows][hit], "links": links[hit], "root": label[hit]})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    rotations: int = ROTATIONS, blocks: int = BLOCKS, words: int = WORDS, cap: float = CAP, block_rows: int = BLOCK_ROWS,
                    seed: int = SEED) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors of the same length whose cosine, in double precision, reaches
    ``threshold`` are linked. Null, empty or zero vectors, and those with null
    or non-finite components, link with nothing. Equal vectors are one node
    with a number of copies. ``component_id`` is the smallest id reachable.
    Rows with a null id are ignored. Rows found are exact; the filters may miss
    a pair, less often the closer it is (measured in the tests); vectors under 64
    components have a lower cap, so that they are found as often.
    """
    src = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    big = F.lit(1.7e308)
    sound = (F.col("v").isNotNull() & (F.size("v") > 0)
             & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= big))
             & F.exists("v", lambda x: x != 0))
    keyed = src.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("v", F.when(F.col("sound"), F.col("v"))).select(
        "id", "v", F.when(F.col("sound"), F.xxhash64("v")).alias("h1"), F.when(F.col("sound"), F.xxhash64(F.lit(7), "v")).alias("h2"))
    ids = cut(keyed.select("id", "h1", "h2"))
    nodes = cut(ids.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = (keyed.where("h1 is not null").join(nodes.select(F.col("rep").alias("id"), "h1", "h2", "copies"), ["id", "h1", "h2"])
            .dropDuplicates(["id", "h1", "h2"]).select("id", "copies", "v"))

    if rotations * words**blocks >= 1 << 31:
        raise ValueError("filters are numbered by 32-bit integers")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby(b["v"].map(len)):
                turned = codes(int(dim), rotations, blocks, words, seed)
                least = cap_for(int(dim), threshold, cap, rotations, blocks, words, seed)
                for k in range(0, len(g), 500):
                    part = g.iloc[k:k + 500]
                    at, found = list_decode(units(part["v"]), turned, least)
                    each = np.split(found.astype(np.int32), np.searchsorted(at, np.arange(1, len(part))))
                    yield pd.DataFrame({"dim": int(dim), "id": part["id"].to_numpy(), "filters": each})

    # per vector, so that the decoding is done once: the filters only, no components
    passed = cut(reps.mapInPandas(decode, "dim int, id long, filters array<int>"))
    sizes = (passed.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter")
             .agg(F.count("*").alias("n")).where("n > 1")
             .select("dim", "filter", F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    met = passed.join(reps, "id").select("dim", "id", "copies", "v", "filters", F.explode("filters").alias("filter"))
    dealt = (met.join(sizes, ["dim", "filter"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("dim", "filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "id", "copies", "v", "filters"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of one (filter, i, j), which may reach over batches."""
        key, held = None, []

        def close() -> Iterator[pd.DataFrame]:
            g = pd.concat(held) if len(held) > 1 else held[0]
            if len(g) < 2:
                return
            sides = [{"id": s["id"].to_numpy(), "copies": s["copies"].to_numpy(), "unit": units(s["v"]),
                      "filters": s["filters"].tolist()} for s in ([g] if key[2] == key[3] else [g[g["own"] == key[2]], g[g["own"] == key[3]]]) if len(s)]
            if key[2] == key[3] or len(sides) == 2:
                found = compare(sides[0], sides[1] if key[2] != key[3] else None, int(key[1]), threshold)
                if found is not None:
                    yield found

        for b in batches:
            if not len(b):
                continue
            k = b[["dim", "filter", "i", "j"]].to_numpy()
            at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1), [True]]))
            for x, y in zip(at, at[1:]):
                if key is not None and tuple(k[x]) == key:
                    held.append(b.iloc[x:y])
                    continue
                if held:
                    yield from close()
                key, held = tuple(k[x]), [b.iloc[x:y]]
        if held:
            yield from close()

    order = ["dim", "filter", "i", "j"]
    found = cut(dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(meet, "rep long, links long, root long"))
    comp = connected_components(found, "rep", "root").select(F.col("node").alias("rep"), "component")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (nodes.join(links, "rep", "left").join(comp, "rep", "left")
               .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c")))
    out = ids.join(classes, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("c", "id").alias("component_id"), (F.col("id") == F.coalesce("c", "id")).alias("kept"))
