"""Lists and text: element order, visibility, values, cursors, marks.

The order is the pre-order walk of the tree that ``after`` spans, siblings by
descending id. Typing gives long chains, so chains are folded first: an element
that follows its predecessor's id by one, is by the same actor and is its only
child continues a run. Runs are found by windows. Only objects with more than
one run are walked, and the walk sees one row per run, not per element.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OP_ID, anchor

OBJ = ["doc_id", "obj"]


def places(first: list, size: list, parent: list, last: list) -> list[int]:
    """Start of each run of one object: an explicit stack, so depth is no limit.

    Runs whose origin is unknown come last, in order of their id.
    """
    known = dict(zip(last, range(len(first))))
    children: dict[int, list[int]] = {}
    for k, p in enumerate(parent):
        children.setdefault(-1 if p is None or pd.isna(p) else known.get(p, -2), []).append(k)
    for c in children.values():
        c.sort(key=lambda k: first[k])  # taken from the end: descending ids
    start, at = [0] * len(first), 0
    for root in (-1, -2):
        stack = list(children.get(root, ()))
        if root == -2:
            stack.reverse()
        while stack:
            k = stack.pop()
            start[k] = at
            at += size[k]
            stack.extend(children.get(k, ()))
    return start


def preorder(g: pd.DataFrame) -> pd.DataFrame:
    """``places`` of the runs of one object, as a group."""
    start = places(list(zip(g["counter"], g["actor"])), g["n"].tolist(), g["parent"].tolist(), g["last"].tolist())
    return g[["doc_id", "obj", "actor", "run"]].assign(start=start)


def elements(ops: DataFrame) -> DataFrame:
    """``(doc_id, obj, elem, value, pos)``: every element, tombstones included, with its position."""
    ins = (ops.where(F.col("action").isin("insert", "splice_text")).withColumn("obj", anchor(F.col("obj")))
           .select(*OBJ, F.col("op").alias("elem"), "value", "after"))
    siblings = F.count("*").over(Window.partitionBy(*OBJ, "after"))
    line = Window.partitionBy(*OBJ, "elem.actor").orderBy("elem.counter")
    cont = F.coalesce((F.col("after") == F.lag("elem").over(line)) & (F.col("elem.counter") == F.lag("elem.counter").over(line) + 1) & (F.col("siblings") == 1), F.lit(False))
    tagged = (ins.withColumn("siblings", siblings).withColumn("cont", cont)
              .withColumn("run", F.sum((~F.col("cont")).cast("int")).over(line)).withColumn("actor", F.col("elem.actor")))
    name = lambda c: F.concat_ws("@", F.col(c)["counter"], F.col(c)["actor"])
    runs = tagged.groupBy(*OBJ, "actor", "run").agg(
        F.min("elem.counter").alias("counter"), F.count("*").alias("n"), F.min_by("after", "elem.counter").alias("origin"), F.max("elem").alias("end"))
    runs = runs.withColumn("parent", F.when(F.col("origin").isNotNull(), name("origin"))).withColumn("last", name("end"))
    counted = runs.withColumn("runs", F.count("*").over(Window.partitionBy(*OBJ)))
    cols = [*OBJ, "actor", "run", "counter", "n", "parent", "last"]
    flat = counted.where("runs = 1").select(*OBJ, "actor", "run", F.lit(0).cast("long").alias("start"))
    # the id of an object travels as text inside the walk
    many = counted.where("runs > 1").withColumn("obj", F.to_json("obj")).select(*cols)
    walked = many.groupBy(*OBJ).applyInPandas(preorder, "doc_id long, obj string, actor string, run long, start long")
    walked = walked.withColumn("obj", F.from_json("obj", OP_ID))
    start = flat.unionByName(walked)
    within = Window.partitionBy(*OBJ, "actor", "run").orderBy("elem.counter")
    return (tagged.withColumn("k", F.row_number().over(within) - 1).join(start, [*OBJ, "actor", "run"])
            .select(*OBJ, "elem", "value", (F.col("start") + F.col("k")).alias("pos")))


def deleted(ops: DataFrame) -> DataFrame:
    return ops.where((F.col("action") == "del") & F.col("key_str").isNull()).select("doc_id", F.explode("pred").alias("elem"))


def assigned(ops: DataFrame) -> DataFrame:
    """The value that the largest ``set`` gives each element, whatever arrived last."""
    sets = ops.where(F.col("action").isin("put", "make_object") & F.col("key_str").isNull())
    return (sets.select("doc_id", F.explode("pred").alias("elem"), "op", "value").groupBy("doc_id", "elem")
            .agg(F.max_by("value", "op").alias("new"), F.max("op").alias("set_by")))


def visible(ops: DataFrame, ordered: DataFrame | None = None) -> DataFrame:
    """``(doc_id, obj, elem, at, value, pos, idx)``: elements that no one deleted, with their visible index.

    ``at`` is the operation that gave the value, the id of an object that it
    made. A delete wins over a concurrent set.
    """
    live = (ordered if ordered is not None else elements(ops)).join(deleted(ops), ["doc_id", "elem"], "left_anti")
    live = live.join(assigned(ops), ["doc_id", "elem"], "left").withColumn("value", F.coalesce("new", "value"))
    idx = F.row_number().over(Window.partitionBy(*OBJ).orderBy("pos")) - 1
    return live.select(*OBJ, "elem", F.coalesce("set_by", "elem").alias("at"), "value", "pos", idx.cast("long").alias("idx"))


def text(shown: DataFrame) -> DataFrame:
    """``(doc_id, obj, text)``: string elements joined in order."""
    return (shown.where(F.col("value")["tag"] == "str").groupBy(*OBJ)
            .agg(F.expr("listagg(value.s, '') within group (order by pos)").alias("text")))


def length(shown: DataFrame) -> DataFrame:
    return shown.groupBy(*OBJ).agg(F.count("*").alias("n"))


def get(shown: DataFrame, index: int) -> DataFrame:
    return shown.where(F.col("idx") == index)


def cursors(shown: DataFrame, index: int) -> DataFrame:
    """The element at an index, as a position that survives edits around it."""
    return shown.where(F.col("idx") == index).select(*OBJ, F.col("elem").alias("cursor"))


def resolve_cursors(cursor: DataFrame, shown: DataFrame) -> DataFrame:
    """Where each cursor's element is now; null once it is deleted."""
    now = shown.select(*OBJ, F.col("elem").alias("cursor"), "idx")
    return cursor.join(now, [*OBJ, "cursor"], "left")


def marks(ops: DataFrame, shown: DataFrame) -> DataFrame:
    """``(doc_id, obj, op, name, value, start, end)`` with an exclusive end; a mark goes with either end."""
    m = (ops.where((F.col("action") == "mark") & F.col("key_str").isNotNull() & (F.size("pred") >= 2)).withColumn("obj", anchor(F.col("obj")))
         .select(*OBJ, "op", F.col("key_str").alias("name"), "value", F.get("pred", 0).alias("a"), F.get("pred", 1).alias("b")))
    at = shown.select("doc_id", "obj", "elem", "idx")
    first = at.select(*OBJ, F.col("elem").alias("a"), F.col("idx").alias("start"))
    last = at.select(*OBJ, F.col("elem").alias("b"), (F.col("idx") + 1).alias("end"))
    return m.join(first, [*OBJ, "a"]).join(last, [*OBJ, "b"]).select(*OBJ, "op", "name", "value", "start", "end")


def splice_ops(commands: DataFrame, shown: DataFrame) -> DataFrame:
    """Text splices ``(doc_id, obj, op, pos, count, text)`` as log rows.

    Deletes name the elements they remove; each character of ``text`` is chained
    to the one before it, the first to the element before ``pos``.
    """
    c = commands.withColumn("obj", anchor(F.col("obj")))
    here = shown.select(*OBJ, "elem", "idx")
    dels = (c.join(here, OBJ).where((F.col("idx") >= F.col("pos")) & (F.col("idx") < F.col("pos") + F.col("count")))
            .select(*OBJ, F.col("op.counter") + F.col("idx") - F.col("pos"), "op.actor", F.col("pos").alias("key_idx"), F.array("elem").alias("pred"))
            .toDF(*OBJ, "counter", "actor", "key_idx", "pred"))
    before = here.select(*OBJ, (F.col("idx") + 1).alias("pos"), F.col("elem").alias("origin"))
    chars = (c.join(before, [*OBJ, "pos"], "left").select(*OBJ, "op", "pos", "count", "origin", F.posexplode(F.split("text", "")).alias("k", "s")).where("s <> ''"))
    counter = F.col("op.counter") + F.col("count") + F.col("k")
    after = F.when(F.col("k") == 0, F.col("origin")).otherwise(F.struct((counter - 1).alias("counter"), F.col("op.actor").alias("actor")))
    from ..schema import op_id, value

    ins = chars.select(*OBJ, op_id(counter, F.col("op.actor")).alias("op"), (F.col("pos") + F.col("k")).cast("bigint").alias("key_idx"),
                       F.lit("splice_text").alias("action"), value("str", F.col("s")).alias("value"), F.array().cast(f"array<{OP_ID}>").alias("pred"), after.alias("after"))
    gone = dels.select(*OBJ, op_id(F.col("counter"), F.col("actor")).alias("op"), F.col("key_idx").cast("bigint").alias("key_idx"), F.lit("del").alias("action"),
                       value("null").alias("value"), "pred", F.lit(None).cast(OP_ID).alias("after"))
    return gone.unionByName(ins).withColumn("key_str", F.lit(None).cast("string"))
