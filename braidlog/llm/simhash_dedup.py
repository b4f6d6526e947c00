"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments A (23 bits), B (23) and C (18).
Two fingerprints that differ in two bits at most have an equal segment, and
the other segments differ in two bits at most. A 23-bit segment is decoded by
the perfect binary Golay code: its fuzzy indices are the codewords nearest to
itself and to each of its 23 neighbours at one bit. Two segments within two
bits have a neighbour in common, hence a fuzzy index. Joined keys pair an
equal segment with a fuzzy index of another one:
(C, fuzzy A), (A, fuzzy B), (B, fuzzy A); candidates are then verified.

Two bits of 64 are far less than what shingle sets at a Jaccard similarity of
0.8 differ by (about 9 bits), and no set of exact keys covers that distance.
Where a similarity is asked for, MinHash bands of the shingles give candidates
beside the fingerprints, and all candidates are verified by their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, tidy

#: The largest number of differing bits that the keys cover.
RADIUS = 2
#: A key held by more fingerprints is resolved by shared one-bit neighbours.
BUCKET = 64
#: Fixed value: generator polynomial of the binary Golay code [23, 12, 7].
GOLAY_GENERATOR = 0b110001110101
#: MinHash bands and the hashes in each: a pair at a Jaccard similarity s shares
#: a band with probability 1 - (1 - s**ROWS)**BANDS, 0.998 at 0.8 and over 0.9999 from 0.85 on.
BANDS, ROWS = 20, 6
#: Texts compared with one text in one group of rows.
COMPARED = 256


def word_shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist())), np.uint64)


def simhash64(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half of the hashes; none give zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(id_col, fp long)``: the 64-bit SimHash of each text's word shingles.

    Null and empty texts have fingerprint zero; fewer words than ``shingle``
    count as one shingle. One row per row, whole texts.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b.iloc[:, 0], "fp": [simhash64(word_shingle_hashes(t, shingle)) for t in b.iloc[:, 1]]})

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInPandas(run, schema)


@lru_cache(maxsize=1)
def _golay() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes by byte of a 23-bit word, and the error pattern of each syndrome."""
    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_GENERATOR << (bit - 11)
        return word

    column = [rest(1 << i) for i in range(23)]
    by_byte = []
    for first in (0, 8, 16):
        t = np.zeros(256, np.int64)
        for x in range(256):
            for i in range(8):
                if x >> i & 1 and first + i < 23:
                    t[x] ^= column[first + i]
        by_byte.append(t)
    errors = np.zeros(2048, np.int64)
    bits = range(23)
    for pattern in [(i,) for i in bits] + [(i, j) for i in bits for j in range(i)] + [(i, j, k) for i in bits for j in range(i) for k in range(j)]:
        s = 0
        for i in pattern:
            s ^= column[i]
        errors[s] = sum(1 << i for i in pattern)
    return by_byte, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    by_byte, errors = _golay()
    s = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words ^ errors[s]) >> 11


def fuzzy_indices(words: np.ndarray) -> np.ndarray:
    """``n x 24``: indices of each word and its one-bit neighbours, repeats included."""
    flips = np.array([0, *(1 << i for i in range(23))], np.int64)
    return golay_index(words[:, None] ^ flips)


def golay_keys(fp: np.ndarray) -> list[np.ndarray]:
    """The distinct join keys of each fingerprint (at most 18)."""
    f = fp.astype(np.int64).view(np.uint64)
    a, b, c = ((f >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    fa, fb = fuzzy_indices(a), fuzzy_indices(b)
    keys = np.concatenate([(kind << 40) | (exact[:, None] << 12) | fuzzy for kind, exact, fuzzy in ((0, c, fa), (1, a, fb), (2, b, fa))], axis=1)
    return [np.unique(k) for k in keys]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Verified links ``(a, b)`` that connect distinct fingerprints within two bits.

    ``fps`` has a distinct long ``fp``. Keys held by ``bucket`` fingerprints at
    most are joined pair by pair. Fingerprints under a fuller key are linked
    through shared one-bit neighbours: two are within two bits exactly if they
    share one, at most 64 others can share it, and each is linked to the
    smallest, so a crowd of near copies gives no pairs by the square and no
    link between its components is lost.
    """
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 20_000):
                fp = b["fp"].to_numpy()[k:k + 20_000]
                keys = golay_keys(fp)
                yield pd.DataFrame({"key": np.concatenate(keys), "fp": np.repeat(fp, [len(x) for x in keys])})

    keyed = cut(fps.select("fp").mapInPandas(explode, "key long, fp long"))
    held = keyed.groupBy("key").agg(F.count("*").alias("n"))
    few, many = held.where((F.col("n") > 1) & (F.col("n") <= bucket)).select("key"), held.where(F.col("n") > bucket).select("key")
    small = keyed.join(few, "key", "left_semi")
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    pairs = left.join(right, (left["key"] == right["key"]) & near).select("a", "b")
    crowd = keyed.join(many, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)))
    stars = (crowd.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
             .groupBy("mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
             .select("a", F.explode("fps").alias("b")).where("a <> b"))
    return pairs.union(stars).distinct()


@lru_cache(maxsize=1)
def _minhash_factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return a | np.uint64(1), b


def minhash_bands(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature of a set of hashes; none for the empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    a, b = _minhash_factors()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[None, k:k + 2048] * a + b).min(1), out=least)
    least, key = least.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, row, fp, node, n, bands)``, one row per row: ``node`` is a hash of the set of ``n`` shingles, ``row`` one of id and text."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, row, text in zip(b["id"], b["row"], b["text"]):
                hashes = word_shingle_hashes(text, shingle)
                own = np.unique(hashes)
                out.append((id_, row, simhash64(hashes), xxhash.xxh64_intdigest(own.tobytes(), 1) - (1 << 63), len(own), minhash_bands(own)))
            yield pd.DataFrame(out, columns=["id", "row", "fp", "node", "n", "bands"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), _row(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInPandas(run, "id string, row long, fp long, node long, n long, bands array<long>")
            .withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)))


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose shingle sets have the Jaccard similarity.

    ``texts`` is ``(node, text)``. The pairs of one ``a`` are dealt to groups of
    about ``COMPARED``; its text goes once to each group.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(COMPARED)).cast("int").alias("parts"))
    one = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    rest = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", F.col("b").alias("node"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for batch in batches:
            found = []
            for a, b, first, text in zip(batch["a"], batch["b"], batch["first"], batch["text"]):
                this = np.unique(word_shingle_hashes(text, shingle))
                if first:
                    own = this
                    continue
                both = len(np.intersect1d(own, this, assume_unique=True))
                if both and both / (len(own) + len(this) - both) >= similarity:
                    found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    rows = one.unionByName(rest).join(texts, "node").select("a", "part", F.coalesce("b", F.lit(0)).alias("b"), F.col("b").isNull().alias("first"), "text")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("first")).mapInPandas(run, "a long, b long")


def similar(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``(node, component)`` of the nodes of ``sketches`` that verified links at the similarity connect; others have no row.

    Candidates share a MinHash band or a component of the fingerprints within
    two bits. First a node is compared with the smallest holder of most of its
    keys, so its text moves once. Then the holders of each key that still holds
    two components are compared in blocks, all pairs of two components. No pair
    is emitted, and no candidate that could join two components is left out.
    """
    prints = nodes.select("fp").distinct()
    comp = connected_components(links(prints), "a", "b").select(F.col("node").alias("fp"), "component")
    by_print = nodes.join(comp, "fp", "left").select("node", "n", F.xxhash64(F.lit(0), F.coalesce("component", "fp")).alias("key"))
    keyed = nodes.select("node", "n", F.explode("bands").alias("key")).unionByName(by_print.where("n > 0"))
    held = (keyed.groupBy("key").agg(F.count("*").alias("holders"), F.min("node").alias("lead"), F.min_by("n", "node").alias("lead_n"))
            .where("holders > 1").select("key", "lead", "lead_n"))
    met = cut(keyed.join(held, "key"))
    involved = nodes.join(met.select("node").distinct(), "node", "left_semi").select("row", "node")
    texts = cut(docs.select(_row(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text")).join(involved, "row")
                .select("node", "text").dropDuplicates(["node"]))

    def fits(x: str, y: str) -> Column:
        return F.least(x, y) / F.greatest(x, y) >= similarity

    stars = (met.where((F.col("node") != F.col("lead")) & fits("n", "lead_n")).groupBy(F.col("lead").alias("a"), F.col("node").alias("b"))
             .agg(F.count("*").alias("shared")))
    first = stars.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("x")).select("x.a", "b")
    comp = _joined(None, cut(verified(cut(first), texts, shingle, similarity)))
    tidy(nodes.sparkSession)
    held = _component(met.select("key", "node"), "node", comp, "component")
    mixed = held.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed"), F.count("*").alias("holders")).where("mixed")
    left = cut(held.join(mixed.select("key", F.ceil(F.col("holders") / F.lit(COMPARED)).cast("int").alias("parts")), "key"))
    if left.limit(1).count():
        comp = _joined(comp, cut(met_in_blocks(left, texts, shingle, similarity)))
    return nodes.sparkSession.createDataFrame([], "node long, component long") if comp is None else comp


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Square matrix: which of the sets of hashes have the Jaccard similarity. Shared hashes are counted in strips of columns."""
    sizes = np.array([len(x) for x in sets], np.float64)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(n > 1, np.cumsum(n > 1) - 1, -1)
    at = number[at]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(sets), len(sets)))
    for low in range(0, int((n > 1).sum()), 4096):
        x, y = np.searchsorted(at, [low, low + 4096])
        strip = np.zeros((len(sets), 4096), np.float32)
        strip[row[x:y], at[x:y] - low] = 1
        both += strip @ strip.T
    return (both > 0) & (both >= similarity * (sizes[:, None] + sizes[None, :] - both))


def met_in_blocks(held: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that connect what holders of a key link to, over all pairs of two components.

    ``held`` is ``(key, node, component, parts)``, the holders of a key dealt to
    ``parts`` blocks of about ``COMPARED``. A text goes to each pair of blocks its
    block is part of; a pair that also holds a smaller key is compared there. No
    pair leaves a task: each linked node is returned with the smallest it reaches.
    """
    keys = held.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = (held.join(keys, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "keys")
             .join(texts, "node"))

    def compare(rows: list) -> list[tuple[int, int]]:
        key, i, j = rows[0][:3]
        own, node, part = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
        if (part == part[0]).all():
            return []
        apart = part[:, None] != part[None, :]
        if i != j:
            apart &= own[:, None] != own[None, :]
        earlier = [x[x < key] for x in (np.asarray(r[6]) for r in rows)]
        ids, at = np.unique(np.concatenate(earlier), return_inverse=True)
        member = np.zeros((len(rows), len(ids)), np.float32)
        member[np.repeat(np.arange(len(rows)), [len(x) for x in earlier]), at] = 1
        apart &= member @ member.T == 0
        if not apart.any():
            return []
        near = apart & alike([np.unique(word_shingle_hashes(r[7], shingle)) for r in rows], similarity)
        hit = np.flatnonzero(near.any(1))
        near, label = near[np.ix_(hit, hit)], node[hit]
        while len(hit):
            new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
            if (new == label).all():
                break
            label = new
        return [(x, y) for x, y in zip(label.tolist(), node[hit].tolist()) if x != y]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of one (key, i, j), which may reach over batches."""
        rows: list = []
        for b in batches:
            found = []
            for r in b.itertuples(index=False, name=None):
                if rows and rows[0][:3] != r[:3]:
                    found += compare(rows)
                    rows = []
                rows.append(r)
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        if rows:
            yield pd.DataFrame(compare(rows), columns=["a", "b"], dtype=np.int64)

    order = ["key", "i", "j"]
    dealt = dealt.select(*order, "own", "node", "component", "keys", "text")
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, "a long, b long")


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components after more links: only what they touch is worked out anew."""
    if not links.limit(1).count():
        return comp
    if comp is None:
        return cut(connected_components(links, "a", "b"))
    ends = _component(_component(links, "a", comp, "c"), "b", comp, "d").select("c", "d")
    moved = connected_components(ends, "c", "d").select(F.col("node").alias("component"), F.col("component").alias("to"))
    every = comp.unionByName(moved.select(F.col("component").alias("node"), "component").join(comp.select("node"), "node", "left_anti"))
    return cut(every.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _component(rows: DataFrame, node: str, comp: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with the component of a node, by the links so far."""
    if comp is None:
        return rows.withColumn(name, F.col(node))
    known = comp.select(F.col("node").alias("__node"), F.col("component").alias(name))
    return rows.join(known, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce(name, node)).drop("__node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    similarity: float | None = None) -> DataFrame:
    """``(id_col, fp long, component_id)``, one row per row of ``docs``.

    With ``similarity``, documents whose sets of shingles have this Jaccard
    similarity at least are linked: every link is verified, and the candidates
    miss a pair at 0.8 with a probability of 0.002, closer ones less often;
    below about 0.7 the bands would find too few. Without it, documents whose
    fingerprints differ in two bits at most are linked;
    ``component_id`` is the smallest id reachable, the own one included. Equal
    fingerprints are collapsed first, so a group of exact copies is one node
    with its members. Null or empty texts link with one another. Rows with a
    null id keep a component only if others share it. Empty input, empty result.
    """
    if similarity is not None:
        rows = cut(sketches(docs, id_col, text_col, shingle))
        nodes = cut(rows.groupBy("node").agg(F.min("id").alias("first"), F.min("row").alias("row"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.first("bands").alias("bands")))
        comp = similar(docs, nodes, id_col, text_col, shingle, similarity)
        tagged = nodes.join(comp, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
        least = tagged.groupBy("component").agg(F.min("first").alias("component_id"))
        classes = tagged.join(least, "component").select("node", "component_id")
        return rows.join(classes, "node").select(F.col("id").alias(id_col), "fp", "component_id")
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("first")))
    comp = connected_components(links(nodes), "a", "b").select(F.col("node").alias("fp"), "component")
    tagged = nodes.join(comp, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = tagged.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = tagged.join(least, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select(id_col, "fp", "component_id")
