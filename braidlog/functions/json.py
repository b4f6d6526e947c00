"""JSON documents: Pointer, Patch, Merge Patch, flatten, and logs from and to JSON.

Pointers known when the plan is made become built-in path expressions. What a
tree needs (patches, differences, flattening) runs in Arrow batches.
"""

from __future__ import annotations

import base64 as b64
import copy
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OPS, value
from ..storage import cut

#: Documents whose operations are written as one batch.
IMPORT_DOCS = 1000
#: Operations of a document that a worker folds in memory; larger ones are folded by rounds.
FOLD_OPS = 100_000
#: Fixed value: an array index of a pointer.
INDEX = re.compile(r"0|[1-9][0-9]*")


class PatchError(ValueError):
    """A pointer or patch that cannot be applied."""


def parse_pointer(pointer: str) -> list[str]:
    """Segments of an RFC 6901 pointer; the empty pointer is the whole document."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise PatchError(f"a pointer starts with a slash: {pointer!r}")
    return [s.replace("~1", "/").replace("~0", "~") for s in pointer[1:].split("/")]


def format_pointer(segments: list[Any]) -> str:
    return "".join("/" + str(s).replace("~", "~0").replace("/", "~1") for s in segments)


def get_pointer(col: Column, pointer: str) -> Column:
    """The value at a pointer of JSON texts, as text; null where it is missing.

    A segment of digits may be an index or a key, and is tried as both.
    """
    paths = [""]
    for s in parse_pointer(pointer):
        if "'" in s or "]" in s:
            raise PatchError("quotes and brackets cannot be part of a path expression; use resolve()")
        paths = [p + f"['{s}']" for p in paths] + ([p + f"[{s}]" for p in paths] if INDEX.fullmatch(s) else [])
    return F.coalesce(*(F.get_json_object(col, "$" + p) for p in paths))


MISSING = object()


def resolve(doc: Any, segments: list[str]) -> Any:
    """The value at the segments, or ``MISSING``."""
    for s in segments:
        if isinstance(doc, dict) and s in doc:
            doc = doc[s]
        elif isinstance(doc, list) and INDEX.fullmatch(s) and int(s) < len(doc):
            doc = doc[int(s)]
        else:
            return MISSING
    return doc


def _parent(doc: Any, segments: list[str]) -> Any:
    p = resolve(doc, segments[:-1])
    if not isinstance(p, (dict, list)):
        raise PatchError(f"no container at {format_pointer(segments[:-1])!r}")
    return p


def add_at(doc: Any, segments: list[str], v: Any) -> Any:
    """Insert into a list (``-`` appends) or set a key; the root is replaced."""
    if not segments:
        return v
    p, s = _parent(doc, segments), segments[-1]
    if isinstance(p, dict):
        p[s] = v
    elif s == "-":
        p.append(v)
    elif INDEX.fullmatch(s) and int(s) <= len(p):
        p.insert(int(s), v)
    else:
        raise PatchError(f"bad index {s!r}")
    return doc


def remove_at(doc: Any, segments: list[str]) -> Any:
    """Remove a key or an element; a missing key is let pass, a missing element is an error."""
    if not segments:
        raise PatchError("the root cannot be removed")
    p, s = _parent(doc, segments), segments[-1]
    if isinstance(p, dict):
        p.pop(s, None)
    elif INDEX.fullmatch(s) and int(s) < len(p):
        del p[int(s)]
    else:
        raise PatchError(f"bad index {s!r}")
    return doc


def put_at(doc: Any, segments: list[str], v: Any) -> Any:
    """Set a value, making maps on the way; ``-`` appends to a list, an index within it is set."""
    if not segments:
        raise PatchError("the root cannot be put")
    at = doc
    for s in segments[:-1]:
        nxt = resolve(at, [s])
        if not isinstance(nxt, (dict, list)):
            nxt = {}
            add_at(at, [s], nxt) if not (isinstance(at, list) and INDEX.fullmatch(s) and int(s) < len(at)) else at.__setitem__(int(s), nxt)
        at = nxt
    s = segments[-1]
    if isinstance(at, list) and INDEX.fullmatch(s) and int(s) < len(at):
        at[int(s)] = v
    else:
        add_at(at, [s], v)
    return doc


def delete_at(doc: Any, segments: list[str]) -> Any:
    """Remove what is there; a missing path is let pass."""
    if not segments:
        raise PatchError("the root cannot be deleted")
    return doc if resolve(doc, segments) is MISSING else remove_at(doc, segments)


def same(a: Any, b: Any) -> bool:
    """Equality that tells booleans from numbers."""
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def apply_patch(doc: Any, patch: Any) -> Any:
    """An RFC 6902 patch, all or nothing: the input is never changed."""
    if not isinstance(patch, list):
        raise PatchError("a patch is an array")
    doc = copy.deepcopy(doc)
    for step in patch:
        try:
            op, path = step["op"], parse_pointer(step["path"])
            if op in ("move", "copy"):
                v = resolve(doc, parse_pointer(step["from"]))
                if v is MISSING:
                    raise PatchError(f"nothing at {step['from']!r}")
                v = copy.deepcopy(v)
                if op == "move":
                    doc = remove_at(doc, parse_pointer(step["from"]))
                doc = add_at(doc, path, v)
            elif op == "add":
                doc = add_at(doc, path, copy.deepcopy(step["value"]))
            elif op == "remove":
                doc = remove_at(doc, path)
            elif op == "replace":
                doc = add_at(remove_at(doc, path) if path else doc, path, copy.deepcopy(step["value"]))
            elif op == "test":
                if not same(resolve(doc, path), step["value"]):
                    raise PatchError(f"test failed at {step['path']!r}")
            else:
                raise PatchError(f"unknown operation {op!r}")
        except (KeyError, TypeError) as e:
            raise PatchError(f"bad step {step!r}") from e
    return doc


def diff(a: Any, b: Any, at: str = "") -> list[dict]:
    """A patch that turns ``a`` into ``b``."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = [{"op": "remove", "path": at + format_pointer([k])} for k in a if k not in b]
        for k, v in b.items():
            p = at + format_pointer([k])
            out += diff(a[k], v, p) if k in a else [{"op": "add", "path": p, "value": v}]
        return out
    if isinstance(a, list) and isinstance(b, list):
        out = [s for k, (x, y) in enumerate(zip(a, b)) for s in diff(x, y, f"{at}/{k}")]
        out += [{"op": "remove", "path": f"{at}/{k}"} for k in range(len(a) - 1, len(b) - 1, -1)]
        return out + [{"op": "add", "path": f"{at}/-", "value": v} for v in b[len(a):]]
    return [] if same(a, b) else [{"op": "replace", "path": at, "value": b}]


def merge(doc: Any, patch: Any, rfc: bool = True) -> Any:
    """A merge patch. ``rfc`` also strips nulls inside objects that are new; otherwise they are kept."""
    if not isinstance(patch, dict):
        return patch
    fresh = not isinstance(doc, dict)
    if fresh and not rfc:
        return patch
    out = {} if fresh else dict(doc)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v, rfc)
    return out


def difference(a: Any, b: Any) -> dict:
    """A merge patch that turns object ``a`` into ``b``: removed keys are null, equal ones left out."""
    out: dict = {k: None for k in a if k not in b}
    for k, v in b.items():
        if k not in a:
            out[k] = v
        elif isinstance(a[k], dict) and isinstance(v, dict):
            if inner := difference(a[k], v):
                out[k] = inner
        elif not same(a[k], v):
            out[k] = v
    return out


def leaves(doc: Any, at: str = "") -> Iterator[tuple[str, Any]]:
    """Pointers and scalars; empty containers have none."""
    if isinstance(doc, dict):
        for k, v in doc.items():
            yield from leaves(v, at + format_pointer([k]))
    elif isinstance(doc, list):
        for k, v in enumerate(doc):
            yield from leaves(v, f"{at}/{k}")
    else:
        yield at, doc


def unflatten_tree(flat: dict[str, Any], lists: bool = False) -> Any:
    """Maps on every level, from pointers; ``lists`` turns maps keyed 0..n-1 into lists."""
    root: dict = {}
    for p, v in flat.items():
        *way, last = parse_pointer(p) or [""]
        at = root
        for s in way:
            at = at.setdefault(s, {})
        at[last] = v

    def listed(x: Any) -> Any:
        if not isinstance(x, dict):
            return x
        x = {k: listed(v) for k, v in x.items()}
        return [x[str(i)] for i in range(len(x))] if x and set(x) == set(map(str, range(len(x)))) else x

    return listed(root) if lists else root


def _dump(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _binary(f, a: Column, b: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _dump(f(json.loads(p), json.loads(q))) for p, q in zip(x, y)])

    return run(a, b)


def merge_patch(doc: Column, patch: Column, rfc: bool = True) -> Column:
    """``doc`` after a merge patch; null if either is null."""
    return _binary(lambda a, b: merge(a, b, rfc), doc, patch)


def generate_merge_patch(a: Column, b: Column) -> Column:
    return _binary(difference, a, b)


def json_patch(doc: Column, patch: Column) -> Column:
    """``doc`` after a JSON patch; a patch that fails is an error of the query."""
    return _binary(apply_patch, doc, patch)


def diff_patch(a: Column, b: Column) -> Column:
    return _binary(diff, a, b)


def flatten(doc: Column) -> Column:
    """An array of ``(pointer, leaf)``, leaves as JSON texts."""
    @F.pandas_udf("array<struct<pointer:string,leaf:string>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else [{"pointer": q, "leaf": _dump(v)} for q, v in leaves(json.loads(p))] for p in x])

    return run(doc)


def unflatten(entries: Column, lists: bool = False) -> Column:
    """JSON from an array of ``(pointer, leaf)``."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else _dump(unflatten_tree({e["pointer"]: json.loads(e["leaf"]) for e in p}, lists)) for p in x])

    return run(entries)


# ---------------------------------------------------------------- logs
def infer(x: Any) -> tuple[str, Any]:
    """The tag of a JSON scalar: integers that fit are signed."""
    if x is None:
        return "null", None
    if isinstance(x, bool):
        return "bool", x
    if isinstance(x, int):
        if -(1 << 63) <= x < 1 << 63:
            return "int", x
        return ("uint", x) if 0 <= x < 1 << 64 else ("double", float(x))
    return ("double", x) if isinstance(x, float) else ("str", x)


def tree_ops(doc: Any, actor: str, start: int = 1, root: tuple | None = None) -> list[dict]:
    """The operations that write a JSON object or list into an empty container, by default the root; scalars write nothing."""
    out, counter = [], start
    stack: list[tuple] = [(root, doc)] if isinstance(doc, dict if root is None else (dict, list)) else []
    while stack:
        obj, node = stack.pop()
        last = None
        for k, v in (node.items() if isinstance(node, dict) else enumerate(node)):
            kind = "map" if isinstance(v, dict) else "list" if isinstance(v, list) else None
            keyed = isinstance(node, dict)
            op = (counter, actor)
            counter += 1
            out.append({"op": op, "obj": obj, "key_str": k if keyed else None, "key_idx": None if keyed else k,
                        "action": "insert" if not keyed else "make_object" if kind else "put", "value": ("obj", kind) if kind else infer(v),
                        "pred": [], "after": None if keyed else last})
            last = op
            if kind:
                stack.append((op, v))
    return out


_FIELDS = {"bool": "b", "int": "i", "uint": "u", "double": "d", "str": "s", "obj": "obj"}
_COLUMNS = ["doc_id", "op", "obj", "key_str", "key_idx", "action", "value", "pred", "after"]


def _log_row(doc: Any, o: dict) -> tuple:
    from decimal import Decimal

    pair = lambda x: None if x is None else {"counter": x[0], "actor": x[1]}
    tag, x = o["value"]
    v = dict.fromkeys(("b", "i", "u", "d", "s", "bin", "obj")) | {"tag": tag}
    if tag in _FIELDS:
        v[_FIELDS[tag]] = Decimal(x) if tag == "uint" else x
    return (doc, pair(o["op"]), pair(o["obj"]), o["key_str"], o["key_idx"], o["action"], v, [pair(p) for p in o["pred"]], pair(o["after"]))


def nodes(col: str) -> Column:
    """How many operations a JSON text below a key takes: one for itself and one for each member of its containers."""
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        def size(t: Any) -> int:
            n, stack = 0, [t]
            while stack:
                t = stack.pop()
                n += 1
                stack.extend(t.values() if isinstance(t, dict) else t if isinstance(t, list) else ())
            return n

        return x.map(lambda t: 0 if t is None else size(json.loads(t)), na_action=None).astype("int64")

    return run(F.col(col))


def subtrees(commands: DataFrame) -> DataFrame:
    """Operations that set ``key_str`` of ``obj`` to the tree ``json``, from id ``op`` on; ``pred`` is superseded."""
    def run(batches):
        for b in batches:
            rows = []
            for doc, op, obj, key, pred, text in b.itertuples(index=False, name=None):
                if text is None:
                    continue
                t, own = json.loads(text), (int(op["counter"]), op["actor"])
                kind = "map" if isinstance(t, dict) else "list" if isinstance(t, list) else None
                first = {"op": own, "obj": (obj["counter"], obj["actor"]) if obj["counter"] else None, "key_str": key, "key_idx": None, "action": "make_object" if kind else "put",
                         "value": ("obj", kind) if kind else infer(t), "pred": [(p["counter"], p["actor"]) for p in pred], "after": None}
                rows += [_log_row(doc, o) for o in (first, *(tree_ops(t, own[1], own[0] + 1, own) if kind else []))]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return commands.select("doc_id", "op", "obj", "key_str", "pred", "json").mapInPandas(run, OPS)


_ACTIONS = ("put", "make_object", "insert")


def _log_batch(docs: list, texts: list, actor: str):
    """The operations of ``tree_ops`` for every document, written by columns: a log has many rows a document."""
    import pyarrow as pa
    from decimal import Decimal

    doc, counter, obj, key, idx, action, tag, val, after = [], [], [], [], [], [], [], [], []
    for d, text in zip(docs, texts):
        tree = None if text is None else json.loads(text)
        if not isinstance(tree, dict):
            continue
        c, stack = 1, [(None, tree)]
        while stack:
            o, node = stack.pop()
            keyed, last = isinstance(node, dict), None
            for k, v in node.items() if keyed else enumerate(node):
                kind = "map" if isinstance(v, dict) else "list" if isinstance(v, list) else None
                t, x = ("obj", kind) if kind else infer(v)
                counter.append(c)
                obj.append(o)
                if keyed:
                    key.append(k)
                    idx.append(None)
                    action.append(1 if kind else 0)
                else:
                    key.append(None)
                    idx.append(k)
                    action.append(2)
                tag.append(t)
                val.append(x)
                after.append(last)
                if not keyed:
                    last = c
                if kind:
                    stack.append((c, v))
                c += 1
        doc += [d] * (c - 1)
    n, tags = len(doc), set(tag)
    ids = pa.struct([("counter", pa.int64()), ("actor", pa.string())])
    actors = pa.repeat(pa.scalar(actor, pa.string()), n)

    def op_ids(counters: list) -> pa.Array:
        at = pa.array(counters, pa.int64())
        return pa.StructArray.from_arrays([at, actors], fields=list(ids), mask=at.is_null())

    def held(name: str, kind: pa.DataType) -> pa.Array:
        if name not in tags:
            return pa.nulls(n, kind)
        return pa.array([x if t == name else None for t, x in zip(tag, val)] if name != "uint" else [Decimal(x) if t == name else None for t, x in zip(tag, val)], kind)

    values = {"tag": pa.array(tag, pa.string()), "b": held("bool", pa.bool_()), "i": held("int", pa.int64()), "u": held("uint", pa.decimal128(20, 0)),
              "d": held("double", pa.float64()), "s": held("str", pa.string()), "bin": pa.nulls(n, pa.binary()), "obj": held("obj", pa.string())}
    actions = pa.DictionaryArray.from_arrays(pa.array(action, pa.int32()), pa.array(_ACTIONS)).cast(pa.string())
    pred = pa.ListArray.from_arrays(pa.repeat(pa.scalar(0, pa.int32()), n + 1), pa.array([], ids))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), op_ids(counter), op_ids(obj), pa.array(key, pa.string()), pa.array(idx, pa.int64()), actions,
         pa.StructArray.from_arrays(list(values.values()), names=list(values)), pred, op_ids(after)], names=_COLUMNS)


def together(df: DataFrame) -> DataFrame:
    """The rows of each ``doc_id`` one after the other in one partition. Documents brought so give a log that stands so."""
    return df.repartition("doc_id").sortWithinPartitions("doc_id")


def import_json(docs: DataFrame, actor: str) -> DataFrame:
    """``(doc_id, json)`` as operation logs; a null text has no operations."""
    def run(batches):
        for b in batches:
            # a few documents at a time: a log is many times its texts
            for at in range(0, b.num_rows, IMPORT_DOCS):
                part = b.slice(at, IMPORT_DOCS)
                yield _log_batch(part.column(0).to_pylist(), part.column(1).to_pylist(), actor)

    return docs.select(F.col("doc_id").cast("bigint"), "json").mapInArrow(run, OPS)


def scalar_json(v: Column) -> Column:
    """A tagged scalar as JSON text; counters and timestamps are numbers, bytes base64."""
    text = F.to_json(F.struct(F.coalesce(v["s"], F.base64(v["bin"])).alias("x")))
    return (F.when(v["tag"] == "null", "null").when(v["tag"] == "bool", v["b"].cast("string")).when(v["tag"].isin("int", "counter", "timestamp"), v["i"].cast("string"))
            .when(v["tag"] == "uint", v["u"].cast("string")).when(v["tag"] == "double", v["d"].cast("string")).otherwise(F.substring(text, 6, F.length(text) - 6)))


def tagged_json(v: Column) -> Column:
    """Like ``scalar_json``, with counters, timestamps and bytes as ``{"__type", "value"}``."""
    wrap = lambda kind, x: F.concat(F.lit('{"__type":"' + kind + '","value":'), x, F.lit("}"))
    return F.when(v["tag"].isin("counter", "timestamp"), F.concat(F.lit('{"__type":"'), v["tag"], F.lit('","value":'), v["i"].cast("string"), F.lit("}"))).when(
        v["tag"] == "bytes", wrap("bytes", scalar_json(v))).otherwise(scalar_json(v))


def from_tagged(x: Any) -> tuple[str, Any]:
    """A scalar from JSON, with its tag honoured; containers are an error."""
    if isinstance(x, dict) and x.get("__type") in ("counter", "timestamp", "bytes"):
        return x["__type"], b64.b64decode(x["value"]) if x["__type"] == "bytes" else int(x["value"])
    if isinstance(x, (dict, list)):
        raise PatchError("not a scalar")
    return infer(x)


def op_id_json(op: Column) -> Column:
    """``{"counter", "actor"}``; null stays null."""
    return F.when(op.isNotNull(), F.to_json(F.struct(op["counter"].alias("counter"), op["actor"].alias("actor"))))


def obj_id_json(obj: Column) -> Column:
    """An object's id as JSON; the root is ``"root"``."""
    return F.when(obj.isNull() | (obj["counter"] == 0), F.lit('"root"')).otherwise(op_id_json(obj))


def text_json(s: Column) -> Column:
    """A string as JSON text; null is ``null``."""
    whole = F.to_json(F.struct(s.alias("x")))
    return F.when(s.isNull(), "null").otherwise(F.substring(whole, 6, F.length(whole) - 6))


def _object(**members: Column) -> Column:
    """A JSON object of members that are JSON texts; null members are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def change_json(actor: Column, seq: Column, start_op: Column, ts_ms: Column, n_ops: Column, deps: Column, message: Column | None = None) -> Column:
    """A change with its operations as a count; a message only where there is one."""
    own = {"actor": text_json(actor), "seq": seq.cast("string"), "start_op": start_op.cast("string"), "timestamp": ts_ms.cast("string"),
           "operations": n_ops.cast("string"), "deps": F.to_json(deps)}
    return _object(**own, **({} if message is None else {"message": F.when(message.isNotNull(), text_json(message))}))


def patch_json(p: DataFrame) -> Column:
    """A row of ``patches`` as ``{"obj", "key", "action": {"type", ...}}``."""
    key = F.when(p["key_str"].isNotNull(), text_json(p["key_str"])).otherwise(F.coalesce(p["index"], F.lit(0)).cast("string"))
    index, count = p["index"].cast("string"), p["count"].cast("string")
    kind = {"put": {"value": tagged_json(p["value"]), "conflict": F.lit("false")}, "insert": {"index": index, "value": tagged_json(p["value"])},
            "delete": {"index": index, "count": count}, "increment": {"delta": p["value"]["i"].cast("string")},
            "splice_text": {"index": index, "delete_count": count, "text": text_json(p["text"])}}
    action = F.lit(None).cast("string")
    for name, members in kind.items():
        action = F.when(p["action"] == name, _object(type=F.lit(f'"{name}"'), **members)).otherwise(action)
    return _object(obj=obj_id_json(p["obj"]), key=key, action=action)


def mark_json(start: Column, end: Column, name: Column, v: Column) -> Column:
    return _object(start=start.cast("string"), end=end.cast("string"), name=text_json(name), value=tagged_json(v))


def cursor_json(cursor: Column) -> Column:
    return _object(position=op_id_json(cursor))


def hex_to_bytes(text: Column) -> Column:
    """Bytes of hexadecimal digits; an odd number of digits or another character is an error."""
    sound = text.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(text.isNotNull(), F.when(sound, F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("not hexadecimal: "), text)).cast("binary")))


# what a row does to its document, beside 0: nothing but that it is there, and -1: to be folded by rounds
_PUT, _DELETE, _INSERT, _REMOVE, _SET = 1, 2, 3, 4, 5


def _fold_rows(ops: DataFrame) -> DataFrame:
    """What ``fold_document`` needs of each operation, in the order of ``ops``. ``pred`` goes as it is: null lists are slow to send."""
    v, keyed, action = F.col("value"), F.col("key_str").isNotNull(), F.col("action")
    put = action.isin("put", "make_object")
    code = (F.when(put & keyed, _PUT).when(put, _SET).when(action.isin("insert", "splice_text"), _INSERT)
            .when((action == "del") & keyed, _DELETE).when(action == "del", _REMOVE).otherwise(0))
    half = lambda c: F.col(c).isNotNull() & (F.col(f"{c}.counter").isNull() | F.col(f"{c}.actor").isNull())
    odd = F.col("op").isNull() | half("op") | half("obj") | half("after") | code.isin(_PUT, _INSERT, _SET) & ~F.coalesce((v["tag"] == "str") == v["s"].isNotNull(), F.lit(False))
    is_obj = v["tag"] == "obj"
    return ops.select(
        "doc_id", F.when(odd & (code != 0), -1).otherwise(code).alias("code"), F.coalesce("op.counter", F.lit(0)).alias("c"), F.col("op.actor").alias("a"),
        F.coalesce("obj.counter", F.lit(0)).alias("oc"), F.coalesce("obj.actor", F.lit("")).alias("oa"), F.col("key_str").alias("key"),
        F.when(F.col("key_str").rlike(r'[\x00-\x1F"\\]'), text_json(F.col("key_str"))).alias("kj"), F.when(~is_obj, scalar_json(v)).alias("json"),
        F.when(is_obj & (put | (action == "insert")), F.coalesce(v["obj"], F.lit("map"))).alias("kind"), v["s"].isNotNull().alias("is_str"),
        "pred", F.coalesce("after.counter", F.lit(0)).alias("fc"), F.col("after.actor").alias("fa"))


def fold_document(rows: list[tuple]) -> str | None:
    """One document as JSON from its operations in any order; null if it is one for the rounds.

    A made object has a larger id than the one that holds it, so objects are
    written from the largest id on and depth is no limit. Repeated or incomplete
    ids and holders that break that order are left to the rounds.
    """
    from ..operators.sequence import places

    root = (0, "")
    dead, gone, sets, puts, inserts, kinds, n = set(), set(), {}, {}, {}, {}, 0
    ids = set()
    for code, c, a, oc, oa, key, kj, text, kind, is_str, pred, fc, fa in rows:
        if code == 0:
            continue
        if code < 0 or c < 1 or a is None:
            return None
        op = (c, a)
        ids.add(op)
        n += 1
        named = ()
        if pred:
            if any(p is None or p["counter"] is None or p["actor"] is None for p in pred):
                return None
            named = [(p["counter"], p["actor"]) for p in pred]
        if code == _REMOVE:
            gone.update(named)
            continue
        if code == _DELETE:
            dead.update(named)
            continue
        if text is None and kind is None:
            return None
        if kind is not None:
            kinds[op] = kind
        if code == _PUT:
            dead.update(named)
            puts.setdefault((oc, oa), []).append((op, key, kj, text))
        elif code == _INSERT:
            inserts.setdefault((oc, oa), []).append((op, None if fa is None else (fc, fa), text, is_str))
        else:
            for p in named:
                if p not in sets or sets[p][0] < op:
                    sets[p] = (op, text, is_str)
    if len(ids) < n:
        return None
    done: dict[tuple, str] = {}
    for obj in (*sorted(kinds, reverse=True), root):
        kind, parts = kinds[obj] if obj is not root else "map", []
        here = inserts.get(obj)
        if here:
            last = None
            for e in here:
                if e[1] != last:  # not one line of typing
                    start = places([e[0] for e in here], [1] * len(here), [e[1] for e in here], [e[0] for e in here])
                    order = sorted(range(len(here)), key=start.__getitem__)
                    if any(start[k] != at for at, k in enumerate(order)):
                        return None
                    here = [here[k] for k in order]
                    break
                last = e[0]
            for op, _, text, is_str in here:
                if op in gone:
                    continue
                if op in sets:
                    op, text, is_str = sets[op]
                if kind == "text":
                    parts.append(text[1:-1] if is_str else "")
                    continue
                if text is None and (text := done.get(op)) is None:
                    return None
                parts.append(text)
        won: dict[str, tuple] = {}
        for p in puts.get(obj, ()) if kind != "text" else ():
            if p[0] not in dead and (p[1] not in won or won[p[1]][0] < p[0]):
                won[p[1]] = p
        for key in sorted(won):
            op, _, kj, text = won[key]
            if text is None and (text := done.get(op)) is None:
                return None
            parts.append((kj or f'"{key}"') + ":" + text)
        done[obj] = f'"{"".join(parts)}"' if kind == "text" else ("[" + ",".join(parts) + "]") if kind == "list" else ("{" + ",".join(parts) + "}")
    return done[root]


def _fold_batches(batches, most: int):
    """``(doc_id, json)`` batches from batches of ``_fold_rows``, each document's rows one after the other."""
    import pyarrow as pa

    def plain(col: pa.Array) -> list:
        if col.null_count == len(col) or pa.types.is_list(col.type) and not len(col.flatten()):
            return [None] * len(col)
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_integer(col.type) and not col.null_count:
            return col.to_numpy(zero_copy_only=False).tolist()
        return col.to_pylist()

    def out(docs: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "json"])

    # the document that may go on in the next batch, as a list of one, and its rows, or null if they are too many
    now: list = []
    held: list | None = []

    def folded() -> str | None:
        return None if held is None or now[0] is None else fold_document(held)

    for b in batches:
        ids, rows = plain(b.column(0)), list(zip(*(plain(b.column(k)) for k in range(1, b.num_columns))))
        starts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
        docs, texts = [], []
        for at, end in zip(starts, [*starts[1:], len(ids)]):
            if now != [ids[at]]:
                if now:
                    docs.append(now[0])
                    texts.append(folded())
                now, held = [ids[at]], []
            if held is not None and len(held) + end - at > most:
                held = None
            elif held is not None:
                held += rows[at:end]
        yield out(docs, texts)
    if now:
        yield out(now, [folded()])


def export_together(ops: DataFrame) -> DataFrame:
    """``export_json`` of a log whose documents' rows stand ``together``: no operation is shuffled or kept.

    A document is folded where its rows are. Those of over ``FOLD_OPS``
    operations and those that ``fold_document`` leaves are folded by rounds.
    """
    most = FOLD_OPS
    done = cut(_fold_rows(ops).mapInArrow(lambda batches: _fold_batches(batches, most), "doc_id bigint, json string"))
    left = done.where("json is null").select(F.col("doc_id").alias("left_id"))
    n = left.count()
    if not n:
        return done
    few = F.broadcast(left) if n <= 10_000 else left
    rest = export_json(ops.join(few, F.col("doc_id").eqNullSafe(F.col("left_id")), "left_semi"))
    return done.where("json is not null").unionByName(rest)


def export_json(ops: DataFrame, shown: DataFrame | None = None, texts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(doc_id, json)`` of whole documents: maps and tables as objects, lists as arrays, text as strings.

    ``ops`` may be a log cut at heads or a clock: children and kinds are then
    those of that time. ``shown`` is ``sequence.visible(ops)`` if it is known.
    ``texts`` holds the text objects, all of them, if their characters are not
    among ``ops`` but in ``runs`` with their marks; where they stand they are
    strings like any other.
    """
    from ..operators import runs, sequence, state

    ops = cut(ops)
    won = state.winners(state.entries(ops)).select("doc_id", "obj", "key_str", F.lit(None).cast("bigint").alias("idx"), "op", "value")
    shown = sequence.visible(ops) if shown is None else shown
    elems = shown.select("doc_id", "obj", F.lit(None).cast("string").alias("key_str"), "idx", F.col("at").alias("op"), "value")
    kinds = state.objects(ops).select("doc_id", "obj", "kind").distinct()
    members = won.unionByName(elems)
    if texts is not None:
        is_text = (F.col("value.tag") == "obj") & F.coalesce(F.col("value.obj") == "text", F.lit(False))
        rest = members.where(~is_text)
        holders = members.where(is_text).select(runs.place("doc_id", "op").alias("at"), F.struct(*members.columns).alias("holder"))
        strings = runs.text(*texts, holders).select("holder.*", "text").withColumn("value", value("str", F.col("text"))).select(*members.columns)
        return _folded(rest.unionByName(strings), kinds, rest.where("value.tag = 'obj'").count())
    return _folded(members, kinds)


def export_maps(won: DataFrame) -> DataFrame:
    """``(doc_id, json)`` of documents made of maps, from their winners."""
    return _folded(won.select("doc_id", "obj", "key_str", F.lit(None).cast("bigint").alias("idx"), "op", "value"), None)


def _folded(members: DataFrame, kinds: DataFrame | None, objects: int | None = None) -> DataFrame:
    """``(doc_id, json)`` of the roots, from members ``(doc_id, obj, key_str or idx, op, value)`` of all objects.

    Children are folded into their parents one level a round until a round
    changes nothing, so any depth is whole; one object is one group. Each round is
    checkpointed to the shared folder. ``objects``: how many members are objects,
    if that is known.
    """
    if kinds is None:
        kinds = members.where("value.tag = 'obj'").select("doc_id", F.col("op").alias("obj"), F.col("value.obj").alias("kind")).unionByName(members.select("doc_id", "obj", F.lit("map").alias("kind")).where("obj.counter = 0").distinct())
    empty = F.when(F.col("kind") == "list", "[]").when(F.col("kind") == "text", '""').otherwise("{}")
    node = members.select("doc_id", "obj", "key_str", "idx", "op", "value", F.when(F.col("value.tag") != "obj", scalar_json(F.col("value"))).alias("json"))

    def fold(rows: DataFrame) -> DataFrame:
        """Each object of ``kinds`` as JSON, from its members as they are now."""
        key = text_json(F.col("key_str"))
        m = F.struct("key_str", "idx", F.when(F.col("key_str").isNotNull(), F.concat(key, F.lit(":"), F.col("json"))).otherwise(F.col("json")).alias("m"), F.when(F.col("key_str").isNull(), F.col("value.s")).alias("s"))  # a string below a key is in m
        got = rows.groupBy("doc_id", "obj").agg(F.array_sort(F.collect_list(m)).alias("x"))
        joined = F.array_join(F.transform("x", lambda x: x["m"]), ",")
        whole = F.when(F.col("kind") == "list", F.concat(F.lit("["), joined, F.lit("]"))).when(
            F.col("kind") == "text", text_json(F.array_join(F.transform("x", lambda x: F.coalesce(x["s"], F.lit(""))), ""))).otherwise(F.concat(F.lit("{"), joined, F.lit("}")))
        return kinds.join(got, ["doc_id", "obj"], "left").select("doc_id", "obj", F.when(F.col("x").isNull(), empty).otherwise(whole).alias("folded"))

    objects = members.where("value.tag = 'obj'").count() if objects is None else objects
    if objects:
        node = cut(node.withColumn("json", F.coalesce("json", F.lit("{}"))))
    # a level holds an object at least, so there are no more rounds than objects
    for _ in range(objects):
        done = fold(node).select("doc_id", F.col("obj").alias("op"), "folded")
        new = F.when(F.col("value.tag") == "obj", F.coalesce("folded", F.lit("{}"))).otherwise(F.col("json"))
        node = cut(node.join(done, ["doc_id", "op"], "left").withColumn("changed", ~new.eqNullSafe(F.col("json"))).withColumn("json", new).select(*node.columns, "changed"))
        ended = not node.where("changed").limit(1).count()
        node = node.drop("changed")
        if ended:
            break
    return fold(node.where("obj.counter = 0")).where("obj.counter = 0").select("doc_id", F.col("folded").alias("json"))
