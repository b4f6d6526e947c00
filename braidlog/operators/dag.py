"""The change graph: heads, closures, missing dependencies, hashes, clocks.

Changes are ``(doc_id, id, actor, seq, deps array)`` with any id type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(changes: DataFrame) -> DataFrame:
    return changes.select("doc_id", "id", F.explode("deps").alias("dep"))


def heads(changes: DataFrame) -> DataFrame:
    """Changes that no other change depends on."""
    return changes.join(edges(changes).select("doc_id", F.col("dep").alias("id")), ["doc_id", "id"], "left_anti")


def missing_deps(changes: DataFrame) -> DataFrame:
    """Dependencies that the log does not hold."""
    return (edges(changes).select("doc_id", F.col("dep").alias("id")).distinct()
            .join(changes.select("doc_id", "id"), ["doc_id", "id"], "left_anti"))


def missing(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``wanted`` ``(doc_id, id)``, those that the log does not hold, each once."""
    return wanted.select("doc_id", "id").distinct().join(changes.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def clock(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc_id", "actor").agg(F.max("seq").alias("max_seq"))


def is_linear(changes: DataFrame) -> DataFrame:
    """Per document, whether every actor's changes number 1..n without gaps."""
    per = changes.groupBy("doc_id", "actor").agg((F.count("*") == F.max("seq")).alias("ok"))
    return per.groupBy("doc_id").agg(F.min("ok").alias("linear"))


def ancestors(changes: DataFrame, of: DataFrame, cut, reverse: bool = False) -> DataFrame:
    """``of`` and all that it depends on (or, reversed, all that depends on it).

    Where each actor's changes form one chain, a closure is a bound of ``seq``
    for each actor. A round moves the bounds by all dependencies below them at
    once, so rounds count the changes of actor on a path, not its length, and a
    round holds one row per actor. Other documents are searched by frontiers.
    ``cut`` materialises a round in shared storage.
    """
    of = of.select("doc_id", "id").distinct()
    own = changes.select("doc_id", "id", "actor", "seq")
    named = edges(changes).join(own, ["doc_id", "id"])
    to = own.toDF("doc_id", "dep", "dep_actor", "dep_seq")
    links = cut(named.join(to, ["doc_id", "dep"]).select("doc_id", "id", "dep", "actor", "seq", "dep_actor", "dep_seq"))
    chained = is_chained(own, links)
    bounded = _bounds(own, links.join(chained, "doc_id", "left_semi"), of.join(chained, "doc_id", "left_semi"), cut, reverse)
    rest = of.join(chained, "doc_id", "left_anti")
    return bounded.unionByName(_search(links.join(chained, "doc_id", "left_anti"), rest, cut, reverse).join(own.select("doc_id", "id"), ["doc_id", "id"], "left_semi"))


def is_chained(changes: DataFrame, links: DataFrame) -> DataFrame:
    """Documents in which every actor's changes number 1..n, each depending on the one before."""
    per = changes.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"), F.count_distinct("actor", "seq").alias("m"), F.min("seq").alias("low"))
    steps = links.where((F.col("actor") == F.col("dep_actor")) & (F.col("seq") == F.col("dep_seq") + 1)).groupBy("doc_id").agg(F.count_distinct("id").alias("steps"))
    top = changes.groupBy("doc_id", "actor").agg(F.max("seq").alias("top")).groupBy("doc_id").agg(F.sum("top").alias("top"))
    whole = (F.col("n") == F.col("m")) & (F.col("top") == F.col("n")) & (F.col("low") == 1) & (F.coalesce("steps", F.lit(0)) == F.col("n") - F.col("actors"))
    return per.join(steps, "doc_id", "left").join(top, "doc_id").where(whole).select("doc_id")


def _bounds(own: DataFrame, links: DataFrame, of: DataFrame, cut, reverse: bool) -> DataFrame:
    pick = F.min if reverse else F.max
    sees = (F.col("dep_seq") >= F.col("bound")) if reverse else (F.col("seq") <= F.col("bound"))
    via, to, to_seq = ("dep_actor", "actor", "seq") if reverse else ("actor", "dep_actor", "dep_seq")
    bounds = cut(own.join(of, ["doc_id", "id"], "left_semi").groupBy("doc_id", "actor").agg(pick("seq").alias("bound")))
    while True:
        at = bounds.withColumnRenamed("actor", via)
        more = links.join(at, ["doc_id", via]).where(sees).select("doc_id", F.col(to).alias("actor"), F.col(to_seq).alias("bound"))
        new = cut(bounds.unionByName(more).groupBy("doc_id", "actor").agg(pick("bound").alias("bound")))
        if not new.join(bounds, ["doc_id", "actor", "bound"], "left_anti").limit(1).count():
            break
        bounds = new
    seen = (F.col("seq") >= F.col("bound")) if reverse else (F.col("seq") <= F.col("bound"))
    return own.join(bounds, ["doc_id", "actor"]).where(seen).select("doc_id", "id")


def _search(links: DataFrame, of: DataFrame, cut, reverse: bool) -> DataFrame:
    a, b = ("dep", "id") if reverse else ("id", "dep")
    step = links.select("doc_id", F.col(a).alias("a"), F.col(b).alias("b"))
    found = front = cut(of)
    while front.limit(1).count():
        more = front.select("doc_id", F.col("id").alias("a")).join(step, ["doc_id", "a"]).select("doc_id", F.col("b").alias("id")).distinct()
        front = cut(more.join(found, ["doc_id", "id"], "left_anti"))
        found = cut(found.unionByName(front))
    return found


def visible_at_heads(ops: DataFrame, changes: DataFrame, heads: DataFrame, cut, change: str = "change") -> DataFrame:
    """Operations of the changes that ``heads`` ``(doc_id, id)`` see, themselves included; no heads, nothing.

    ``change`` names the column of ``ops`` that holds the id of its change. Every
    state plan composes with the result: get, keys, text, marks, export at heads.
    """
    seen = ancestors(changes, heads, cut).withColumnRenamed("id", change)
    return ops.join(seen, ["doc_id", change], "left_semi")


def visible_by_clock(changes: DataFrame, at: DataFrame) -> DataFrame:
    """Changes with ``seq`` up to the clock ``(doc_id, actor, max_seq)``: one join, for linear histories."""
    return changes.join(at, ["doc_id", "actor"]).where("seq <= max_seq").drop("max_seq")


def changes_since(changes: DataFrame, known: DataFrame) -> DataFrame:
    """The history without ``known`` ``(doc_id, id)``, the closure of what a peer has."""
    return changes.join(known.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def by_hash(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Changes for ``(doc_id, place, id)`` requests, with the place kept."""
    return wanted.join(changes, ["doc_id", "id"])


def le64(x: Column) -> Column:
    """Eight little-endian bytes of a long."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8))))


def change_hash(actor: Column, seq: Column, start_op: Column, ts_ms: Column, n_ops: Column, deps: Column) -> Column:
    """SHA-256 over the binary actor, four little-endian numbers and the sorted binary dependencies, as hex.

    Contents and message are not part of it, so joins never rely on it alone.
    """
    head = F.concat(actor, le64(seq), le64(start_op), le64(ts_ms), le64(n_ops))
    tail = F.unhex(F.array_join(F.transform(deps, lambda d: F.hex(d)), ""))
    return F.sha2(F.concat(head, tail), 256)
