"""Map state: live entries, winners, conflicts, counters, objects, paths.

A put or delete supersedes exactly the entries it names in ``pred``. The live
entries are the puts that nothing names: one anti-join, whatever the order in
which operations arrived. Everything else is an aggregation over live entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import anchor, typed

KEY = ["doc_id", "obj", "key_str"]


def dedupe(ops: DataFrame) -> DataFrame:
    """One row per operation id, however often it was delivered."""
    return ops.dropDuplicates(["doc_id", "op"])


def _map_ops(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("key_str").isNotNull()).withColumn("obj", anchor(F.col("obj")))


def superseded(ops: DataFrame) -> DataFrame:
    """``(doc_id, op)`` of map entries that a put, object or delete has named."""
    w = ops.where(F.col("key_str").isNotNull() & F.col("action").isin("put", "make_object", "del"))
    return w.select("doc_id", F.explode("pred").alias("op"))


def entries(ops: DataFrame) -> DataFrame:
    """Live map entries ``(doc_id, obj, key_str, op, value)``; several at a key are a conflict.

    A concurrent put survives a delete that has not seen it (add wins).
    """
    puts = _map_ops(ops).where(F.col("action").isin("put", "make_object")).select(*KEY, "op", "value")
    return puts.join(superseded(ops), ["doc_id", "op"], "left_anti").select(*KEY, "op", "value")


def winners(live: DataFrame) -> DataFrame:
    """The entry with the largest id at each key. Partial maxima are taken before the shuffle."""
    return live.groupBy(*KEY).agg(F.max_by(F.struct("op", "value"), "op").alias("w")).select(*KEY, "w.op", "w.value")


def conflict_counts(live: DataFrame) -> DataFrame:
    return live.groupBy(*KEY).agg(F.count("*").alias("n"))


def keys(live: DataFrame) -> DataFrame:
    """Distinct keys of every map; byte order is the order of the column."""
    return live.select(*KEY).distinct()


def map_length(live: DataFrame) -> DataFrame:
    return live.groupBy("doc_id", "obj").agg(F.count_distinct("key_str").alias("n"))


def typed_get(live: DataFrame, tag: str) -> DataFrame:
    """Winners as one type; null where the winner has another."""
    return winners(live).select(*KEY, typed(F.col("value"), tag).alias("v"))


def counters(ops: DataFrame, live: DataFrame) -> DataFrame:
    """Live counters with the increments that named them: base plus the sum of deltas.

    Deltas are summed per entry before they meet the entries, so a counter that
    is incremented without end is one pre-aggregated row.
    """
    deltas = (ops.where((F.col("action") == "increment") & F.col("key_str").isNotNull())
              .select("doc_id", F.explode("pred").alias("op"), F.col("value")["i"].alias("delta"))
              .groupBy("doc_id", "op").agg(F.sum("delta").alias("delta")))
    return (live.where(F.col("value")["tag"] == "counter").join(deltas, ["doc_id", "op"], "left")
            .select(*KEY, "op", (F.col("value")["i"] + F.coalesce("delta", F.lit(0))).alias("v")))


def objects(ops: DataFrame) -> DataFrame:
    """``(doc_id, obj, kind)``: the root map of each document and every object ever made."""
    made = ops.where(F.col("value")["tag"] == "obj").where(F.col("action").isin("put", "make_object", "insert"))
    roots = ops.select("doc_id").distinct().select("doc_id", anchor(F.lit(None).cast(ops.schema["obj"].dataType)).alias("obj"), F.lit("map").alias("kind"))
    return roots.unionByName(made.select("doc_id", F.col("op").alias("obj"), F.col("value")["obj"].alias("kind")))


def get_path(live: DataFrame, path: list[str | int | Column], shown: DataFrame | None = None) -> DataFrame:
    """The winner at the end of a path from the root: one join per further step.

    Integers are visible indices of lists, whose elements ``shown`` holds.
    Documents in which a step is missing or is a scalar have no row.
    """
    won = winners(live)
    at = won.where((F.col("obj.counter") == 0) & (F.col("key_str") == path[0])).select("doc_id", "op", "value")
    for step in path[1:]:
        if isinstance(step, int):
            inner = shown.where(F.col("idx") == step).select("doc_id", "obj", F.col("at").alias("op"), "value")
        else:
            inner = won.where(F.col("key_str") == step)
        child = inner.select("doc_id", F.col("obj").alias("parent"), F.col("op").alias("o"), F.col("value").alias("v"))
        at = (at.where(F.col("value")["tag"] == "obj").withColumnRenamed("op", "parent").drop("value")
              .join(child, ["doc_id", "parent"]).select("doc_id", F.col("o").alias("op"), F.col("v").alias("value")))
    return at


def get_obj_id(live: DataFrame, path: list[str | int | Column], shown: DataFrame | None = None) -> DataFrame:
    """``(doc_id, obj, kind)``: the object at the end of a path; no row where a scalar stands there."""
    found = get_path(live, path, shown).where(F.col("value")["tag"] == "obj")
    return found.select("doc_id", F.col("op").alias("obj"), F.col("value")["obj"].alias("kind"))


def clock(ops: DataFrame) -> DataFrame:
    return ops.groupBy("doc_id", "op.actor").agg(F.max("op.counter").alias("max_counter"))


def next_counter(ops: DataFrame) -> DataFrame:
    return ops.groupBy("doc_id").agg((F.max("op.counter") + 1).alias("next_counter"))


def actor_table(ops: DataFrame) -> DataFrame:
    """Distinct actors of each document over ids, objects, origins and predecessors, with the counter of their first use."""
    ids = F.concat(F.array("op", "obj", "after"), F.coalesce("pred", F.array().cast(ops.schema["pred"].dataType)))
    seen = ops.select("doc_id", F.col("op.counter").alias("at"), F.explode(F.filter(ids, lambda x: x.isNotNull())).alias("x"))
    return seen.groupBy("doc_id", "x.actor").agg(F.min("at").alias("first"))


def actor_places(ops: DataFrame, local: str) -> DataFrame:
    """``actor_table`` with each actor's ``place``: ``local`` first, the others by first use, then by name."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.col("actor") != local, "first", "actor")
    return actor_table(ops).withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def with_pred(commands: DataFrame, live: DataFrame) -> DataFrame:
    """Commands ``(doc_id, obj, key_str, ...)`` with the ids of the live entries at their key as ``pred``."""
    at = live.groupBy(*KEY).agg(F.sort_array(F.collect_list("op")).alias("pred"))
    empty = F.array().cast("array<struct<counter:bigint,actor:string>>")
    return (commands.withColumn("obj", anchor(F.col("obj"))).join(at, KEY, "left").withColumn("pred", F.coalesce("pred", empty)))
