"""Synchronising replicas: Bloom filters over change hashes and what to send.

Changes are ``(doc_id, id, deps, ...)``. A filter only saves traffic: whatever
it hides by mistake is asked for by the receiver, who knows exactly what it
lacks, so replicas converge to the union in a further round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dag

#: Fixed values of the filter format: bits for each entry, and probes.
BITS_PER_ENTRY, PROBES = 10, 7


def probes(hashes: list[str], n_bits: int) -> np.ndarray:
    """Bit positions of hex hashes: three little-endian words stepped by triple hashing."""
    raw = np.array([np.frombuffer(bytes.fromhex(h[:24]), "<u4") for h in hashes], np.uint64).reshape(-1, 3) % np.uint64(n_bits)
    x, y, z = raw.T.copy()
    out = [x]
    for _ in range(PROBES - 1):
        x = (x + y) % np.uint64(n_bits)
        y = (y + z) % np.uint64(n_bits)
        out.append(x)
    return np.stack(out, 1).astype(np.int64)

def filter_bits(hashes: list[str]) -> bytes:
    """The filter of a set of hashes; no entries give no bits."""
    if not hashes:
        return b""
    bits = np.zeros(-(-len(hashes) * BITS_PER_ENTRY // 8) * 8, np.uint8)
    bits[probes(hashes, len(bits)).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()

def contains(bits: bytes, hashes: list[str]) -> np.ndarray:
    """Whether each hash may be in the filter; an empty filter holds nothing."""
    if not bits:
        return np.zeros(len(hashes), bool)
    on = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    return on[probes(hashes, len(on))].all(1)

def _bits(n: Column) -> Column:
    return F.ceil(n * BITS_PER_ENTRY / 8) * 8

def _positions(h: Column, n_bits: Column) -> Column:
    """``probes`` of one hex hash in built-in arithmetic."""
    word = lambda k: F.conv(F.concat(*(F.substring(h, 8 * k + 7 - 2 * i, 2) for i in range(4))), 16, 10).cast("long") % n_bits
    x, y, z = word(0), word(1), word(2)
    # the k-th position of triple hashing is x + k y + z k (k - 1) / 2
    return F.array(*((x + F.lit(k) * y + F.lit(k * (k - 1) // 2) * z) % n_bits for k in range(PROBES)))

def build_filters(changes: DataFrame, by: list[str], hash_col: str = "hash") -> DataFrame:
    """``(by..., n, word, bits long)``: one filter per group, as its words of 64 bits that are not zero.

    Bit positions depend on the group's size only, so rows set their bits on
    their own, and bits are merged word by word before they are shuffled.
    """
    sizes = changes.groupBy(*by).agg(F.count("*").alias("n"))
    at = changes.join(sizes, by).select(*by, "n", F.explode(_positions(F.col(hash_col), _bits(F.col("n")))).alias("p"))
    return at.groupBy(*by, "n", F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))

def filter_bytes(filters: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., bits binary)``: the filters as the wire has them, one small row per group."""
    @F.pandas_udf("binary")
    def packed(words: pd.Series, n: pd.Series) -> pd.Series:
        def one(ws, k: int) -> bytes:
            out = np.zeros(-(-(-(-k * BITS_PER_ENTRY // 8)) // 8), np.uint64)
            for w in ws:
                out[w["word"]] = w["bits"] & (1 << 64) - 1
            return out.tobytes()[:-(-k * BITS_PER_ENTRY // 8)]

        return pd.Series([one(w, int(k)) for w, k in zip(words, n)])

    return filters.groupBy(*by, "n").agg(F.collect_list(F.struct("word", "bits")).alias("words")).select(*by, packed("words", "n").alias("bits"))

def probe(changes: DataFrame, filters: DataFrame, by: list[str], hash_col: str = "hash") -> DataFrame:
    """``changes`` with ``maybe``: whether the group's filter may hold the hash; no filter holds nothing.

    Only the probes are joined with words of the filters; all must be set.
    """
    sizes = filters.select(*by, F.col("n").alias("__n")).distinct()
    asked = changes.join(sizes, by, "left").withColumn("__id", F.col(hash_col))
    p = asked.where("__n is not null").select(*by, "__id", F.explode(_positions(F.col("__id"), _bits(F.col("__n")))).alias("p")).withColumn("word", F.floor(F.col("p") / 64))
    hit = F.coalesce(F.expr("(shiftright(bits, cast(p % 64 as int)) & 1L) = 1"), F.lit(False))
    test = p.join(filters.select(*by, "word", "bits"), [*by, "word"], "left").groupBy(*by, "__id").agg(F.min(hit).alias("maybe"))
    return asked.drop("__n").join(test, [*by, "__id"], "left").withColumn("maybe", F.coalesce("maybe", F.lit(False))).drop("__id")

def with_hash(changes: DataFrame) -> DataFrame:
    """Changes with a hash of their identity: document, actor and number. Where there is a ``hash`` it is kept."""
    if "hash" in changes.columns:
        return changes
    return changes.withColumn("hash", F.sha2(F.concat_ws("|", "doc_id", "actor", "seq"), 256))

def _past(mine: DataFrame, shared: DataFrame | None, cut) -> DataFrame:
    """``mine`` with hashes, without the shared heads and what they depend on."""
    if shared is None:
        return with_hash(mine)
    known = dag.ancestors(mine, shared.join(mine.select("doc_id", "id"), ["doc_id", "id"], "left_semi"), cut)
    return with_hash(mine).join(known, ["doc_id", "id"], "left_anti")


def message(mine: DataFrame, theirs_heads: DataFrame, shared: DataFrame | None, cut) -> dict[str, DataFrame]:
    """What a replica says: its ``heads``, a filter of its changes past the ``shared`` ones (``have``), and what it ``need``s.

    It needs the heads of the peer that it lacks, and dependencies of its own
    changes that it lacks. ``shared`` ``(doc_id, id)`` are the heads that both had
    when they last spoke; None if they never did.
    """
    lacks = theirs_heads.select("doc_id", "id").unionByName(dag.missing_deps(mine)).distinct().join(mine.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    past = _past(mine, shared, cut)
    return {"heads": cut(dag.heads(mine).select("doc_id", "id")), "have": cut(build_filters(past, ["doc_id"])), "need": cut(lacks), "shared": shared}

def to_send(mine: DataFrame, said: dict[str, DataFrame], cut) -> DataFrame:
    """Changes for a peer's ``message``: past the shared heads, those that its filter does not hold and all that depend on them; and what it needs.

    A change that the filter holds by mistake is left out now; the peer, who sees
    a head or a dependency that it lacks, asks for it in its next message.
    """
    past = _past(mine, said["shared"], cut)
    unseen = cut(probe(past, said["have"], ["doc_id"]).where(~F.col("maybe")).select("doc_id", "id"))
    later = dag.ancestors(mine, unseen, cut, reverse=True)
    asked = said["need"].join(mine.select("doc_id", "id"), ["doc_id", "id"], "left_semi")
    return mine.join(later.unionByName(asked).distinct(), ["doc_id", "id"], "left_semi")

def receive(mine: DataFrame, sent: DataFrame) -> DataFrame:
    """Add what was sent; a change that is already here is not added again."""
    return mine.unionByName(sent.join(mine.select("doc_id", "id"), ["doc_id", "id"], "left_anti"))

def shared_heads(changes: DataFrame, peer_heads: DataFrame) -> DataFrame:
    """The peer's heads that are here: from then on both have all that they depend on."""
    return peer_heads.join(changes.select("doc_id", "id"), ["doc_id", "id"], "left_semi")

def synchronise(a: DataFrame, b: DataFrame, cut, shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Both logs after as many exchanges as they need to agree, and how many those were.

    A round is one message and one answer in each direction. It ends when neither
    lacks a head of the other or a dependency of its own; every round with a need
    moves a change at least, so there are no more rounds than changes.
    """
    a, b, rounds = cut(a), cut(b), 0
    while True:
        heads_a, heads_b = cut(dag.heads(a).select("doc_id", "id")), cut(dag.heads(b).select("doc_id", "id"))
        apart = heads_a.join(heads_b, ["doc_id", "id"], "left_anti").unionByName(heads_b.join(heads_a, ["doc_id", "id"], "left_anti"))
        gaps = dag.missing_deps(a).unionByName(dag.missing_deps(b))
        if not apart.limit(1).count() and not gaps.limit(1).count():
            return a, b, rounds
        say_a, say_b = message(a, heads_b, shared, cut), message(b, heads_a, shared, cut)
        new_a, new_b = cut(receive(a, to_send(b, say_a, cut))), cut(receive(b, to_send(a, say_b, cut)))
        rounds += 1
        if new_a.count() + new_b.count() == a.count() + b.count():  # neither has what the other lacks
            return new_a, new_b, rounds
        a, b = new_a, new_b
