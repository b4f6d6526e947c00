"""Merging replicas and reading the past. Every plan here keeps the log a set of operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(*logs: DataFrame) -> DataFrame:
    """The union of any number of logs, each operation once: one shuffle, whatever their number.

    Commutative, associative, idempotent; an empty log is neutral.
    """
    return reduce(lambda a, b: a.unionByName(b), logs).dropDuplicates(["doc_id", "op"])


def apply_changes(log: DataFrame, more: DataFrame) -> DataFrame:
    """Add operations that may have been delivered before."""
    return merge(log, more)


def missing_changes(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Of their changes, those past my clock."""
    have = mine.groupBy("doc_id", "actor").agg(F.max("seq").alias("max_seq"))
    return theirs.join(have, ["doc_id", "actor"], "left").where("max_seq is null or seq > max_seq").drop("max_seq")


def fork(log: DataFrame, actors: list[str]) -> DataFrame:
    """A branch for each actor: the immutable log is shared, and each writes under its own name.

    Returns the log once per branch with ``branch``; writing to branches and
    merging them again is one plan over all of them.
    """
    return log.withColumn("branch", F.explode(F.array(*map(F.lit, actors))))


def visible_at(ops: DataFrame, clock: DataFrame) -> DataFrame:
    """Operations up to a cut ``(doc_id, actor, max_counter)``; a missing actor sees nothing.

    An empty cut is the empty document. Every state plan composes with it, so
    get_at, keys_at, text_at and marks_at are the usual plans on this log.
    """
    c = clock.select("doc_id", F.col("actor").alias("a"), "max_counter")
    return (ops.join(c, (ops["doc_id"] == c["doc_id"]) & (F.col("op.actor") == F.col("a")) & (F.col("op.counter") <= F.col("max_counter")), "left_semi"))
