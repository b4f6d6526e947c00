"""Writing: operations for tables of commands, and the changes that commit them.

A command table has a row for each edit: ``doc_id``, ``actor``, ``obj`` (null:
the root), ``n`` (its place among the document's edits, from 0) and what the
edit needs. All edits of one document in a table are one transaction; they see
the state before it. Identifiers follow the document's largest counter, so a
generator is one join with the state and no replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OP_ID, anchor, op_id, value
from . import dag, state
from .patches import patches

COLUMNS = ["doc_id", "op", "obj", "key_str", "key_idx", "action", "value", "pred", "after"]


def numbered(commands: DataFrame, ops: DataFrame, width: Column | None = None) -> DataFrame:
    """``commands`` with ``op``: the next id of its document, ``width`` ids further for each edit before it."""
    top = ops.groupBy("doc_id").agg(F.max("op.counter").alias("__top"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(width if width is not None else F.lit(1)).over(w), F.lit(0))
    return (commands.join(top, "doc_id", "left").withColumn("op", op_id(F.coalesce("__top", F.lit(0)) + 1 + before, F.col("actor"))).drop("__top"))


def _rows(df: DataFrame, action: str, val: Column, pred: Column | None = None, after: Column | None = None, key: str | None = None, idx: Column | None = None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    root = F.when(F.col("obj.counter") != 0, F.col("obj"))
    return df.select("doc_id", "op", root.cast(OP_ID).alias("obj"), (F.col(key) if key else none("string")).alias("key_str"),
                     (idx if idx is not None else none("bigint")).cast("bigint").alias("key_idx"), F.lit(action).alias("action"), val.alias("value"),
                     (pred if pred is not None else F.array()).cast(f"array<{OP_ID}>").alias("pred"), (after if after is not None else none(OP_ID)).cast(OP_ID).alias("after"))


def put(commands: DataFrame, ops: DataFrame) -> DataFrame:
    """Set ``key_str`` to ``value``: supersedes all that is at the key. An object value makes the object, whose id is ``op``."""
    c = state.with_pred(numbered(commands, ops), state.entries(ops))
    action = F.when(F.col("value")["tag"] == "obj", "make_object").otherwise("put")
    return _rows(c, "put", F.col("value"), F.col("pred"), key="key_str").withColumn("action", action)


def put_all(commands: DataFrame, ops: DataFrame) -> DataFrame:
    """Set every key of the map ``values``, in the order of the keys."""
    each = commands.select("*", F.explode(F.map_entries("values")).alias("__e")).select("*", F.col("__e.key").alias("key_str"), F.col("__e.value").alias("value"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "key_str")) - 1
    return put(each.withColumn("n", place).drop("__e", "values"), ops)


def delete_key(commands: DataFrame, ops: DataFrame) -> DataFrame:
    """Delete ``key_str``; a key that is not there gives a delete of nothing."""
    c = state.with_pred(numbered(commands, ops), state.entries(ops))
    return _rows(c, "del", value("null"), F.col("pred"), key="key_str")


def increment(commands: DataFrame, ops: DataFrame) -> DataFrame:
    """Add ``delta`` to the counters at ``key_str``; a key that holds none stops the query."""
    live = state.entries(ops).where(F.col("value")["tag"] == "counter")
    c = state.with_pred(numbered(commands, ops), live)
    checked = F.when(F.size("pred") > 0, F.col("pred")).otherwise(F.raise_error(F.concat(F.lit("no counter at "), F.col("key_str"))).cast(f"array<{OP_ID}>"))
    return _rows(c, "increment", value("counter", F.col("delta")), checked, key="key_str")


def _at(commands: DataFrame, shown: DataFrame, shift: int, name: str) -> DataFrame:
    """``commands`` with the element at ``index + shift`` as ``name``, null where there is none."""
    here = shown.select("doc_id", "obj", (F.col("idx") - shift).alias("index"), F.col("elem").alias(name))
    return commands.withColumn("obj", anchor(F.col("obj"))).join(here, ["doc_id", "obj", "index"], "left")


def _there(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.concat(F.lit("no element at index "), F.col("index").cast("string"))).cast(OP_ID))


def insert(commands: DataFrame, ops: DataFrame, shown: DataFrame) -> DataFrame:
    """Insert ``value`` before the element at ``index``; an object value makes the object."""
    c = _at(numbered(commands, ops), shown, -1, "before")
    return _rows(c, "insert", F.col("value"), after=F.when(F.col("index") > 0, _there("before")), idx=F.col("index"))


def insert_all(commands: DataFrame, ops: DataFrame, shown: DataFrame) -> DataFrame:
    """Insert the array ``values`` before the element at ``index``: each after the one before it."""
    c = _at(numbered(commands, ops, F.size("values")), shown, -1, "before")
    c = c.select("*", F.posexplode("values").alias("k", "value")).withColumn("start", F.col("op.counter"))
    after = F.when(F.col("k") > 0, op_id(F.col("start") + F.col("k") - 1, F.col("actor"))).when(F.col("index") > 0, _there("before"))
    return _rows(c.withColumn("op", op_id(F.col("start") + F.col("k"), F.col("actor"))), "insert", F.col("value"), after=after, idx=F.col("index") + F.col("k"))


def set_index(commands: DataFrame, ops: DataFrame, shown: DataFrame) -> DataFrame:
    """Give the element at ``index`` another ``value``."""
    c = _at(numbered(commands, ops), shown, 0, "elem")
    return _rows(c, "put", F.col("value"), F.array(_there("elem")), idx=F.col("index"))


def delete_index(commands: DataFrame, ops: DataFrame, shown: DataFrame) -> DataFrame:
    c = _at(numbered(commands, ops), shown, 0, "elem")
    return _rows(c, "del", value("null"), F.array(_there("elem")), idx=F.col("index"))


def mark(commands: DataFrame, ops: DataFrame, shown: DataFrame) -> DataFrame:
    """Mark the elements from ``start`` to before ``end`` with ``name`` and ``value``."""
    c = _at(numbered(commands, ops).withColumn("index", F.col("start")), shown, 0, "a")
    c = _at(c.withColumn("index", F.col("end") - 1), shown, 0, "b")
    return _rows(c, "mark", F.col("value"), F.array(_there("a"), _there("b")), key="name")


def put_json(commands: DataFrame, ops: DataFrame) -> DataFrame:
    """Set ``key_str`` to the tree ``json``: maps and lists become objects, what was at the key is superseded."""
    from ..functions import json as js

    c = state.with_pred(numbered(commands, ops, js.nodes("json")), state.entries(ops))
    return js.subtrees(c)


def commit(new: DataFrame, changes: DataFrame, actor: str) -> DataFrame:
    """One change ``(doc_id, id, actor, seq, deps, start_op, n_ops)`` for each document with new operations.

    It depends on the document's heads and becomes its only head. Its ``id``
    follows the largest of the document; no operations, no change.
    """
    own = new.groupBy("doc_id").agg(F.min("op.counter").alias("start_op"), F.count("*").alias("n_ops"))
    heads = dag.heads(changes).groupBy("doc_id").agg(F.sort_array(F.collect_list("id")).alias("deps"))
    last = changes.groupBy("doc_id").agg((F.max("id") + 1).alias("id"), F.coalesce(F.max(F.when(F.col("actor") == actor, F.col("seq"))), F.lit(0)).alias("seen"))
    deps = F.coalesce("deps", F.array().cast(changes.schema["deps"].dataType))
    return (own.join(heads, "doc_id", "left").join(last, "doc_id", "left")
            .select("doc_id", F.coalesce("id", F.lit(1)).alias("id"), F.lit(actor).alias("actor"), (F.coalesce("seen", F.lit(0)) + 1).alias("seq"), deps.alias("deps"), "start_op", "n_ops"))


def transact(ops: DataFrame, changes: DataFrame, new: DataFrame, actor: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log and the changes with ``new`` committed, and the patches that tell of it."""
    made = commit(new, changes, actor)
    log = ops.select(*COLUMNS).unionByName(new.select(*COLUMNS))
    return log, changes.select("doc_id", "id", "actor", "seq", "deps").unionByName(made.select("doc_id", "id", "actor", "seq", "deps")), patches(new, ["doc_id"])
