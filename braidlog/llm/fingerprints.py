"""Document fingerprints: SimHash over weighted terms, in DataFrame operations only.

A term is a pair of neighbouring words (the last word is paired with nothing);
its weight is its length in characters, up to 31, so pairs of short common
words weigh little. Every term votes on 128 signed bits. Two bits are counted
in the halves of one long, so a document takes 64 sums in one hash aggregation
and only those are shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Largest number of differing bits for which the block tables find every
#: fingerprint; rows of one bucket of neighbouring documents.
RADIUS, BUCKET_ROWS = 3, 1000
MAX_WEIGHT = 31
_LANES = (1 << 32) | 1


def _terms(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    words = F.regexp_extract_all(F.col(text), F.lit(WORD_PATTERN), F.lit(0))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    g = texts.select(*key, words.alias("w")).select(*key, F.explode_outer(zipped).alias("g"))
    a, b = F.col("g")["a"], F.col("g")["b"]
    weight = F.when(a.isNull(), 0).otherwise(F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(MAX_WEIGHT))).cast("long")
    return g.select(*key, F.xxhash64(a, b).alias("h0"), F.xxhash64(F.lit(11), a, b).alias("h1"), weight.alias("weight"))


def simhash(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(*key, f0 long, f1 long)``: the fingerprint of each text; ``key`` is distinct.

    A bit is one if the terms that set it weigh over half of all. Texts without
    words, null ones included, have fingerprint zero.
    """
    terms = _terms(texts, key, text)
    sums = [F.sum(F.shiftrightunsigned(f"h{half}", i).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"s{half}_{i}") for half in (0, 1) for i in range(32)]
    g = terms.groupBy(*key).agg(F.sum("weight").alias("all"), *sums)

    def word(half: int) -> Column:
        bits = []
        for i in range(32):
            s = F.col(f"s{half}_{i}")
            for at, lane in ((i, s.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(s, 32))):
                bits.append(F.when(2 * lane > F.col("all"), F.lit((1 << at) - (1 << 64 if at == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    return g.select(*key, word(0).alias("f0"), word(1).alias("f1"))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(d: Column) -> Column:
    """The cosine that ``d`` of 128 differing bits stands for, at least 0."""
    return F.when(d >= 64, 0.0).otherwise(F.round(F.cos(F.lit(3.141592653589793) * d / 128), 6))


def as_hex(f0: Column, f1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def search(queries: DataFrame, nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(q0, q1, f0, f1, distance)``: for each query all fingerprints within ``radius`` bits.

    Both inputs have distinct ``f0, f1``; a fingerprint finds itself. With
    radius r the 128 bits are cut into r + 1 blocks, one of which must be equal.
    Each of r + 1 permuted tables leads with another block; a pair is reported
    by the first table whose leading block agrees, so once.
    """
    if not 0 <= radius <= 7:
        raise ValueError("the radius is 0 to 7")
    width = 128 // (radius + 1)

    def blocks(a: str, b: str) -> list[Column]:
        out = []
        for k in range(radius + 1):
            lo, hi = k * width, 128 if k == radius else (k + 1) * width
            parts = []
            for c, start in ((a, 0), (b, 64)):
                x, y = max(lo, start), min(hi, start + 64)
                if x < y:
                    mask = (1 << (y - x)) - 1
                    parts.append(F.shiftrightunsigned(c, x - start).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long")))
            out.append(parts[0] if len(parts) == 1 else F.xxhash64(*parts))
        return out

    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.col("f0").alias(a), F.col("f1").alias(b)).select(a, b, F.posexplode(F.array(*blocks(a, b))).alias("t", "block"))

    q, n = tables(queries, "q0", "q1"), tables(nodes, "f0", "f1")
    same = [x == y for x, y in zip(blocks("q0", "q1"), blocks("f0", "f1"))]
    first = reduce(lambda rest, k: F.when(same[k], k).otherwise(rest), range(radius, -1, -1), F.lit(-1))
    d = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    return q.join(n, (q["t"] == n["t"]) & (q["block"] == n["block"]) & (d <= radius) & (first == q["t"])).select("q0", "q1", "f0", "f1", d.alias("distance"))


def neighbours(docs: DataFrame, id_col: str, text_col: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document beside the next one by descending id, in buckets of neighbours.

    Returns ``(bucket, place, ghost, id, text, next_text)``; places count within
    a bucket. Ids are cut at quantiles, and between quantiles evenly, so any
    spread of ids gives buckets of about ``rows`` rows. The row after a bucket's
    last is the first of the bucket below; it is added to the bucket as a ghost
    that has no successor itself. Below the lowest bucket stands the highest.
    Equal ids are ordered by the text's hash; null ids come last.
    """
    low = -(1 << 62)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("at"), text.alias("text"))
    steps = 256
    stats = src.agg(F.count("*").alias("n"), F.percentile_approx("at", [i / steps for i in range(steps + 1)], 10000).alias("q")).first()
    if not stats["n"]:
        return src.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("place"), F.lit(False).alias("ghost"), "id", "text", F.col("text").alias("next_text"))
    cuts = sorted(set(stats["q"]))
    fine = max(1, -(-stats["n"] // (rows * len(cuts))))
    k = F.size(F.filter(F.array(*(F.lit(c) for c in cuts[1:])), lambda c: c <= F.col("at")))
    lows = F.array(*(F.lit(c) for c in cuts))
    width = F.array(*(F.lit(max(1, b - a)) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1])))
    inner = F.floor((F.col("at") - F.get(lows, k)).cast("double") / F.get(width, k) * fine)
    bucket = k.cast("long") * fine + F.least(F.greatest(inner, F.lit(0)), F.lit(fine - 1))
    src = src.withColumn("bucket", bucket)
    tops = cut(src.groupBy("bucket").agg(F.max("at").alias("top")))
    # one row per bucket, len(cuts) * fine at most
    above = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    first = F.min("bucket").over(Window.partitionBy())
    ghosts = tops.select(F.col("top").alias("at"), F.col("bucket").alias("from"), F.coalesce(F.lead("bucket").over(above), first).alias("into"),
                         (F.col("bucket") == last).alias("wraps")).select("at", "from", F.col("into").alias("bucket"))
    ghosts = F.broadcast(ghosts) if len(cuts) * fine <= 500_000 else ghosts
    guests = src.withColumnRenamed("bucket", "from").join(ghosts, ["at", "from"]).select("bucket", F.lit(True).alias("ghost"), "id", "at", "text")
    every = src.select("bucket", F.lit(False).alias("ghost"), "id", "at", "text").unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("at").desc(), F.xxhash64("text"))
    return every.select("bucket", F.row_number().over(order).alias("place"), "ghost", "id", "text", F.lead("text").over(order).alias("next_text"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Fingerprints of documents, of their edited texts and of their successors.

    Returns ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, f0, f1)``, one row per row of ``docs``. The edited
    text has its last floor(n_chars / 2) code points replaced by as many (or
    all) of the next document's first ones. A single row is its own successor.
    """
    near = neighbours(docs, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
                      F.expr("substring(next_text, 1, cast(floor(char_length(text) / 2) as int))"))
    rows = near.select("bucket", "place", "ghost", "id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("ghost"), edited).alias("edited"))
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    both = rows.select("bucket", "place", "ghost", "id", "n_chars", "sha",
                       F.explode(F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("x"))))
                                 .otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("x"))))).alias("t"))
    both = both.select("bucket", "place", "ghost", "id", "n_chars", "sha", "t.kind", "t.x")
    key = ["bucket", "place", "ghost", "id", "n_chars", "sha"]
    prints = simhash(both, [*key, "kind"], "x")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    flat = prints.groupBy(*key).agg(*(pick(kind, c).alias(f"{name}{c[1]}") for kind, name in ((0, "f"), (1, "e")) for c in ("f0", "f1")))
    order = Window.partitionBy("bucket").orderBy("place")
    flat = flat.withColumn("n0", F.lead("f0").over(order)).withColumn("n1", F.lead("f1").over(order)).where("not ghost")
    c = F.col
    return flat.select(c("id").alias(id_col), "n_chars", c("sha").alias("edited_sha256"), as_hex(c("f0"), c("f1")).alias("fingerprint"),
                       as_hex(c("e0"), c("e1")).alias("edited_fingerprint"), likeness(distance(c("f0"), c("f1"), c("e0"), c("e1"))).alias("near_edited"),
                       likeness(distance(c("f0"), c("f1"), c("n0"), c("n1"))).alias("near_next"), "f0", "f1")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, every: int = 50) -> DataFrame:
    """``with_edits`` and ``n_near``: for ids divisible by ``every``, how many other
    documents have a fingerprint within ``radius`` bits (null for other ids)."""
    prints = cut(with_edits(docs, id_col, text_col, radius))
    asks = F.col(id_col) % every == 0
    nodes = prints.groupBy("f0", "f1").agg(F.count("*").alias("n"))
    queries = prints.where(asks).select("f0", "f1").distinct()
    found = search(queries, nodes.select("f0", "f1"), radius).join(nodes, ["f0", "f1"]).groupBy("q0", "q1").agg((F.sum("n") - 1).alias("n_near"))
    return (prints.join(found, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1")), "left")
            .select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                    F.when(asks, F.col("n_near")).alias("n_near")))
