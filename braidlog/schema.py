"""Types of the operation log and constructors for its values.

One row of ``ops`` is one operation. ``op`` is a Lamport counter and an actor;
structs compare field by field, so the order of operations is the order of the
struct. ``obj`` is the id of the containing object, null for the root map.
Actors are strings (lower-case hex keeps the byte order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OP_ID = "struct<counter:bigint,actor:string>"
VALUE = "struct<tag:string,b:boolean,i:bigint,u:decimal(20,0),d:double,s:string,bin:binary,obj:string>"
OPS = (f"doc_id bigint, op {OP_ID}, obj {OP_ID}, key_str string, key_idx bigint, action string, "
       f"value {VALUE}, pred array<{OP_ID}>, after {OP_ID}")
CHANGES = ("doc_id bigint, hash string, actor string, seq bigint, start_op bigint, ts_ms bigint, "
           "message string, deps array<string>, n_ops bigint")

#: Operation kinds, object kinds and value tags.
ACTIONS = ("put", "del", "insert", "make_object", "increment", "splice_text", "mark")
OBJECT_KINDS = ("map", "list", "text", "table")
TAGS = ("null", "bool", "int", "uint", "double", "counter", "timestamp", "str", "bytes", "obj")

_FIELD = {"bool": "b", "int": "i", "counter": "i", "timestamp": "i", "uint": "u", "double": "d", "str": "s", "bytes": "bin", "obj": "obj"}
_TYPE = {"b": "boolean", "i": "bigint", "u": "decimal(20,0)", "d": "double", "s": "string", "bin": "binary", "obj": "string"}


def op_id(counter: Column, actor: Column) -> Column:
    """The id of an operation; null if the counter is."""
    return F.when(counter.isNotNull(), F.struct(counter.cast("bigint").alias("counter"), actor.cast("string").alias("actor")))


def value(tag: Column | str, col: Column | None = None, kind: str | None = None) -> Column:
    """A tagged value. ``tag`` names the kind; for a tag that varies by row, ``kind`` names the field's tag."""
    name = kind or tag
    field = _FIELD.get(name) if isinstance(name, str) else None
    tag = F.lit(tag) if isinstance(tag, str) else tag
    parts = [tag.alias("tag")] + [(col if f == field and col is not None else F.lit(None)).cast(t).alias(f) for f, t in _TYPE.items()]
    return F.struct(*parts)


def typed(v: Column, tag: str) -> Column:
    """The value as ``tag``; null where it has another tag. Nothing is converted."""
    if tag == "null":
        return F.when(v["tag"] == "null", F.lit(True))
    return F.when(v["tag"] == tag, v[_FIELD[tag]])


def is_object(v: Column) -> Column:
    return v["tag"] == "obj"


def is_scalar(v: Column) -> Column:
    return v["tag"] != "obj"


def is_root(obj: Column) -> Column:
    return obj.isNull()


def anchor(obj: Column) -> Column:
    """``obj`` with the root as a value, so that it joins and groups like the rest."""
    return F.coalesce(obj, op_id(F.lit(0), F.lit("")))
