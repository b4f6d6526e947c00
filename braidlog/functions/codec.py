"""Encodings of the binary document format, and their relational counterparts.

The binary format is read and written document by document: a document's log
is one group of rows. The relational forms (runs, deltas) are window plans.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OPS

# ---------------------------------------------------------------- fixed values of the format
MAGIC = bytes([0x85, 0x6F, 0x4A, 0x83])
CHUNK_DOCUMENT, CHUNK_CHANGE, CHUNK_COMPRESSED = 0, 1, 2
DEFLATE_ABOVE, INFLATE_MOST = 256, 64 << 20
TAG = {"null": 0, "false": 1, "true": 2, "uint": 3, "int": 4, "double": 5, "str": 6, "bytes": 7, "counter": 8, "timestamp": 9}
KINDS = ("map", "list", "text", "table")
#: (column id << 4) | column type
SPEC = {"obj_actor": 0x01, "obj_counter": 0x02, "key_actor": 0x11, "key_counter": 0x12, "key_string": 0x14, "insert": 0x33,
        "action": 0x47, "value_meta": 0x55, "value_raw": 0x56, "pred_group": 0x70, "pred_actor": 0x71, "pred_counter": 0x72,
        "expand": 0x93, "mark_name": 0xA4}
ACTION = {"make_keyed": 0, "put": 1, "make_ordered": 2, "del": 3, "increment": 4, "mark": 5}
DEFLATED = 8


class FormatError(ValueError):
    """Bytes that are not a document of this format."""


# ---------------------------------------------------------------- numbers
def uleb128(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def sleb128(n: int) -> bytes:
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        done = (n == 0 and not low & 0x40) or (n == -1 and low & 0x40)
        out.append(low | (0 if done else 0x80))
        if done:
            return bytes(out)


def read_uleb128(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """The number and the place after it; None if it is cut off or over ten bytes."""
    n = 0
    for k in range(10):
        if at + k >= len(data):
            return None
        n |= (data[at + k] & 0x7F) << (7 * k)
        if data[at + k] < 0x80:
            return n, at + k + 1
    return None


def read_sleb128(data: bytes, at: int = 0) -> tuple[int, int] | None:
    got = read_uleb128(data, at)
    if got is None:
        return None
    n, end = got
    width = 7 * (end - at)
    return (n - (1 << width) if n >> (width - 1) & 1 else n), end


class Reader:
    """A place in a byte string; reading past the end raises ``FormatError``."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("unexpected end")
        self.at += n
        return self.data[self.at - n:self.at]

    def _number(self, read) -> int:
        got = read(self.data, self.at)
        if got is None:
            raise FormatError("bad number")
        self.at = got[1]
        return got[0]

    def uint(self) -> int:
        return self._number(read_uleb128)

    def sint(self) -> int:
        return self._number(read_sleb128)

    @property
    def done(self) -> bool:
        return self.at >= len(self.data)


# ---------------------------------------------------------------- columns
_PUT = {"uint": uleb128, "int": sleb128, "str": lambda s: uleb128(len(s.encode())) + s.encode()}
_GET = {"uint": Reader.uint, "int": Reader.sint, "str": lambda r: r.take(r.uint()).decode()}


def rle_encode(values: list, kind: str) -> bytes:
    """Runs: ``+n value`` for n equal ones, ``-n values`` for n unequal ones, ``0 n`` for n nulls."""
    put, out, literal = _PUT[kind], bytearray(), []

    def flush() -> None:
        if literal:
            out.extend(sleb128(-len(literal)) + b"".join(map(put, literal)))
            literal.clear()

    k = 0
    while k < len(values):
        end = k
        while end < len(values) and values[end] == values[k]:
            end += 1
        if values[k] is None:
            flush()
            out.extend(sleb128(0) + uleb128(end - k))
        elif end - k > 1:
            flush()
            out.extend(sleb128(end - k) + put(values[k]))
        else:
            literal.append(values[k])
        k = end
    flush()
    return bytes(out)


def rle_decode(data: bytes, kind: str, most: int = 1 << 40) -> list:
    r, get, out = Reader(data), _GET[kind], []
    while not r.done and len(out) < most:
        n = r.sint()
        if n > 0:
            out += [get(r)] * min(n, most - len(out))
        elif n < 0:
            out += [get(r) for _ in range(-n)]
        else:
            out += [None] * min(r.uint(), most - len(out))
    return out


def delta_encode(values: list[int | None]) -> bytes:
    """Runs of differences; a null keeps the last number."""
    last, out = 0, []
    for v in values:
        out.append(None if v is None else v - last)
        last = last if v is None else v
    return rle_encode(out, "int")


def delta_decode(data: bytes, most: int = 1 << 40) -> list[int | None]:
    last, out = 0, []
    for d in rle_decode(data, "int", most):
        last = last if d is None else last + d
        out.append(None if d is None else last)
    return out


def bool_encode(values: list[bool]) -> bytes:
    """Lengths of alternating runs, false first."""
    out, now, n = bytearray(), False, 0
    for v in values:
        if bool(v) != now:
            out += uleb128(n)
            now, n = bool(v), 0
        n += 1
    return bytes(out + uleb128(n)) if values else b""


def bool_decode(data: bytes, most: int = 1 << 40) -> list[bool]:
    r, out, now = Reader(data), [], False
    while not r.done and len(out) < most:
        out += [now] * min(r.uint(), most - len(out))
        now = not now
    return out


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


def inflate(data: bytes) -> bytes:
    d = zlib.decompressobj(wbits=-15)
    try:
        out = d.decompress(data, INFLATE_MOST + 1)
    except zlib.error as e:
        raise FormatError(str(e)) from e
    if len(out) > INFLATE_MOST or not d.eof:
        raise FormatError("inflated column is too long or cut off")
    return out


def write_columns(columns: dict[int, bytes]) -> bytes:
    full = {k: v for k, v in columns.items() if v}
    head = b"".join(uleb128(k) + uleb128(len(v)) for k, v in full.items())
    return uleb128(len(full)) + head + b"".join(full.values())


def read_columns(r: Reader) -> dict[int, bytes]:
    """Column bytes by spec, without the deflate bit."""
    out = {}
    for spec, n in [(r.uint(), r.uint()) for _ in range(r.uint())]:
        data = r.take(n)
        if spec & DEFLATED and data:
            inner = Reader(data)
            inner.uint()
            data = inflate(data[inner.at:])
        out[spec & ~DEFLATED] = data
    return out


# ---------------------------------------------------------------- chunks
def write_chunk(kind: int, body: bytes) -> bytes:
    return MAGIC + hashlib.sha256(body).digest()[:4] + bytes([kind]) + uleb128(len(body)) + body


def read_chunk(data: bytes) -> tuple[int, bytes]:
    """The kind and body; a wrong magic, length or checksum raises ``FormatError``."""
    r = Reader(data)
    if r.take(4) != MAGIC:
        raise FormatError("bad magic")
    check, kind = r.take(4), r.take(1)[0]
    body = r.take(r.uint())
    if hashlib.sha256(body).digest()[:4] != check:
        raise FormatError("bad checksum")
    return kind, body


# ---------------------------------------------------------------- values and operations
def encode_value(v: tuple[str, Any]) -> tuple[bytes, bytes]:
    """``(meta, raw)`` of a ``(tag, value)``."""
    tag, x = v
    if tag == "obj":
        tag, x = "uint", KINDS.index(x)
    if tag == "bool":
        tag, raw = ("true" if x else "false"), b""
    elif tag == "null":
        raw = b""
    elif tag == "uint":
        raw = uleb128(int(x))
    elif tag in ("int", "counter", "timestamp"):
        raw = sleb128(int(x))
    elif tag == "double":
        raw = struct.pack("<d", x)
    else:
        raw = x.encode() if tag == "str" else bytes(x)
    return uleb128(len(raw) << 4 | TAG[tag]), raw


def decode_value(meta: int, raw: Reader) -> tuple[str, Any]:
    name = {n: t for t, n in TAG.items()}.get(meta & 15)
    data = raw.take(meta >> 4)
    if name is None:
        raise FormatError("unknown value tag")
    if name in ("true", "false"):
        return "bool", name == "true"
    if name == "null":
        return "null", None
    if name == "uint":
        return name, Reader(data).uint()
    if name in ("int", "counter", "timestamp"):
        return name, Reader(data).sint()
    if name == "double":
        if len(data) != 8:
            raise FormatError("bad double")
        return name, struct.unpack("<d", data)[0]
    return name, data.decode() if name == "str" else data


def encode_ops(ops: list[dict], actors: dict[str, int]) -> dict[int, bytes]:
    """Columns of operations; list indices are not kept, a string inserted into a list reads back as text."""
    col: dict[str, list] = {k: [] for k in SPEC}
    meta, raw = b"", b""
    for o in ops:
        obj, after, pred = o["obj"], o["after"], o["pred"]
        ref = after or (pred[0] if pred and o["action"] not in ("insert", "splice_text") else None)
        keyed = o["key_str"] is not None
        col["obj_actor"].append(None if obj is None else actors[obj[1]])
        col["obj_counter"].append(0 if obj is None else obj[0])
        col["key_actor"].append(None if keyed or ref is None else actors[ref[1]])
        col["key_counter"].append(None if keyed else ref[0] if ref else 0)
        col["key_string"].append(o["key_str"])
        col["insert"].append(o["action"] in ("insert", "splice_text"))
        made = o["value"][1] if o["value"][0] == "obj" else None
        code = ("make_keyed" if made in ("map", "table") else "make_ordered" if made else None) if o["action"] == "make_object" else o["action"]
        col["action"].append(ACTION.get(code, ACTION["put"]))
        m, x = encode_value(o["value"])
        meta, raw = meta + m, raw + x
        col["pred_group"].append(len(pred))
        col["pred_actor"] += [actors[p[1]] for p in pred]
        col["pred_counter"] += [p[0] for p in pred]
        col["expand"].append(o["action"] == "mark")
        col["mark_name"].append(o["key_str"] if o["action"] == "mark" else None)
    enc = {}
    for name, spec in SPEC.items():
        kind = spec & 7
        if name in ("value_meta", "value_raw"):
            enc[spec] = meta if name == "value_meta" else raw
        elif name in ("expand", "mark_name") and not any(col["expand"]):
            continue
        else:
            enc[spec] = (delta_encode(col[name]) if kind == 2 else bool_encode(col[name]) if kind == 3 else rle_encode(col[name], "str" if kind == 4 else "uint"))
    return enc


def decode_ops(columns: dict[int, bytes], actors: list[str], actor: str, start_op: int, n: int) -> list[dict]:
    get = lambda name: columns.get(SPEC[name], b"")

    def full(xs: list, fill=None) -> list:
        return xs + [fill] * (n - len(xs))

    def who(k: int) -> str:
        if not 0 <= k < len(actors):
            raise FormatError("unknown actor")
        return actors[k]

    obj_a, obj_c = full(rle_decode(get("obj_actor"), "uint", n)), full(delta_decode(get("obj_counter"), n))
    key_a, key_c = full(rle_decode(get("key_actor"), "uint", n)), full(delta_decode(get("key_counter"), n))
    key_s, inserts = full(rle_decode(get("key_string"), "str", n)), full(bool_decode(get("insert"), n), False)
    codes, groups = full(rle_decode(get("action"), "uint", n), ACTION["put"]), full(rle_decode(get("pred_group"), "uint", n), 0)
    preds = zip(rle_decode(get("pred_actor"), "uint"), delta_decode(get("pred_counter")))
    meta, raw, out = Reader(get("value_meta")), Reader(get("value_raw")), []
    for k in range(n):
        tag, x = decode_value(meta.uint(), raw)
        code, keyed = codes[k], key_s[k] is not None
        if code in (ACTION["make_keyed"], ACTION["make_ordered"]) and tag == "uint":
            if x >= len(KINDS):
                raise FormatError("unknown object kind")
            tag, x = "obj", KINDS[x]
        names = {ACTION["del"]: "del", ACTION["increment"]: "increment", ACTION["mark"]: "mark"}
        action = ("splice_text" if tag == "str" else "insert") if inserts[k] else names.get(code, "make_object" if tag == "obj" else "put")
        pred = [(c, who(a)) for a, c in (next(preds, (-1, 0)) for _ in range(groups[k] or 0))]
        ref = None if key_a[k] is None or not inserts[k] else (key_c[k], who(key_a[k]))
        out.append({"op": (start_op + k, actor), "obj": None if obj_a[k] is None else (obj_c[k], who(obj_a[k])), "key_str": key_s[k],
                    "key_idx": None if keyed else 0, "action": action, "value": (tag, x), "pred": pred, "after": ref})
    return out


# ---------------------------------------------------------------- documents
def actor_table(changes: list[dict], local: str) -> list[str]:
    """Actors in order of first use, the local one first."""
    seen = {local: None}
    for c in changes:
        seen.setdefault(c["actor"])
        for o in c["ops"]:
            for x in (o["op"], o["obj"], o["after"], *o["pred"]):
                if x is not None:
                    seen.setdefault(x[1])
    return list(seen)


def encode_change(c: dict, actors: dict[str, int]) -> bytes:
    out = uleb128(actors[c["actor"]]) + uleb128(c["seq"]) + uleb128(c["start_op"]) + sleb128(c.get("ts_ms") or 0)
    text = (c.get("message") or "").encode()
    out += uleb128(len(text)) + text + uleb128(len(c["deps"])) + b"".join(bytes.fromhex(d) for d in c["deps"]) + uleb128(len(c["ops"]))
    columns = {}
    for spec, data in encode_ops(c["ops"], actors).items():
        if len(data) > DEFLATE_ABOVE and len(small := deflate(data)) < len(data):
            spec, data = spec | DEFLATED, uleb128(len(data)) + small
        columns[spec] = data
    return out + write_columns(columns)


def decode_change(data: bytes, actors: list[str]) -> dict:
    r = Reader(data)
    k = r.uint()
    if k >= len(actors):
        raise FormatError("unknown actor")
    seq, start, ts = r.uint(), r.uint(), r.sint()
    message = r.take(r.uint()).decode() or None
    deps = [r.take(32).hex() for _ in range(r.uint())]
    n = r.uint()
    return {"actor": actors[k], "seq": seq, "start_op": start, "ts_ms": ts, "message": message, "deps": deps,
            "ops": decode_ops(read_columns(r), actors, actors[k], start, n)}


def encode_document(changes: list[dict], heads: list[str], local: str, next_counter: int, local_seq: int) -> bytes:
    table = actor_table(changes, local)
    index = {a: i for i, a in enumerate(table)}
    clock: dict[str, int] = {}
    for c in changes:
        clock[c["actor"]] = max(c["seq"], clock.get(c["actor"], 0))
    body = uleb128(len(table)) + b"".join(uleb128(16) + bytes.fromhex(a) for a in table)
    body += uleb128(len(heads)) + b"".join(map(bytes.fromhex, heads)) + uleb128(len(changes))
    for c in changes:
        one = encode_change(c, index)
        body += uleb128(len(one)) + one
    body += uleb128(index[local]) + uleb128(next_counter) + uleb128(local_seq) + uleb128(len(clock))
    body += b"".join(uleb128(index[a]) + uleb128(n) for a, n in sorted(clock.items()))
    return write_chunk(CHUNK_DOCUMENT, body)


def decode_document(data: bytes) -> dict:
    """``actor, next_counter, local_seq, heads, clock, changes``; anything amiss raises ``FormatError``."""
    kind, body = read_chunk(bytes(data))
    if kind != CHUNK_DOCUMENT:
        raise FormatError("not a document chunk")
    r = Reader(body)
    actors = []
    for _ in range(r.uint()):
        if r.uint() != 16:
            raise FormatError("bad actor")
        actors.append(r.take(16).hex())
    heads = [r.take(32).hex() for _ in range(r.uint())]
    try:
        changes = [decode_change(r.take(r.uint()), actors) for _ in range(r.uint())]
        local, counter, seq = r.uint(), r.uint(), r.uint()
        clock = {actors[r.uint()]: r.uint() for _ in range(r.uint())}
        return {"actor": actors[local], "next_counter": counter, "local_seq": seq, "heads": heads, "clock": clock, "changes": changes}
    except (IndexError, UnicodeDecodeError) as e:
        raise FormatError(str(e)) from e


def change_hash(c: dict) -> str:
    """SHA-256 of actor, sequence, start, time, number of operations and dependencies, as hex."""
    head = bytes.fromhex(c["actor"]) + b"".join(struct.pack("<q", x) for x in (c["seq"], c["start_op"], c.get("ts_ms") or 0, len(c["ops"])))
    return hashlib.sha256(head + b"".join(map(bytes.fromhex, c["deps"]))).hexdigest()


# ---------------------------------------------------------------- logs in DataFrames
def _plain(o) -> dict:
    pair = lambda x: None if x is None else (int(x["counter"]), x["actor"])
    v = o["value"]
    field = {"bool": "b", "int": "i", "counter": "i", "timestamp": "i", "uint": "u", "double": "d", "str": "s", "bytes": "bin", "obj": "obj"}.get(v["tag"])
    return {"op": pair(o["op"]), "obj": pair(o["obj"]), "key_str": o["key_str"], "key_idx": o["key_idx"], "action": o["action"],
            "value": (v["tag"], v[field] if field else None), "pred": [pair(p) for p in (o["pred"] if o["pred"] is not None else [])], "after": pair(o["after"])}


def actor_hex(name: str) -> str:
    """A 16-byte actor id: 32 hex digits as they are, else the name's bytes, padded."""
    if len(name) == 32 and all(c in "0123456789abcdef" for c in name):
        return name
    return name.encode()[:16].ljust(16, b"\0").hex()


def save(ops: DataFrame) -> DataFrame:
    """``(doc_id, data binary)``: each document's log as one binary document.

    Operations of one actor with counters in a row are one change. A group holds
    one document, as the format does.
    """
    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((_plain(r) for r in g.to_dict("records")), key=lambda o: o["op"])
        named = lambda x: None if x is None else (x[0], actor_hex(x[1]))
        for o in rows:
            o |= {"op": named(o["op"]), "obj": named(o["obj"]), "after": named(o["after"]), "pred": [named(p) for p in o["pred"]]}
        changes, last = [], {}
        for o in sorted(rows, key=lambda o: (o["op"][1], o["op"][0])):
            a, n = o["op"][1], o["op"][0]
            c = last.get(a)
            if c is None or c["start_op"] + len(c["ops"]) != n:
                deps = [change_hash(c)] if c else []
                last[a] = c = {"actor": a, "seq": c["seq"] + 1 if c else 1, "start_op": n, "deps": deps, "ops": []}
                changes.append(c)
            c["ops"].append(o)
        changes.sort(key=lambda c: (c["start_op"], c["actor"]))
        used = {d for c in changes for d in c["deps"]}
        heads = sorted(h for c in changes if (h := change_hash(c)) not in used)
        local = changes[0]["actor"]
        return pd.DataFrame({"doc_id": [key[0]], "data": [encode_document(changes, heads, local, rows[-1]["op"][0] + 1, 0)]})

    return ops.select("doc_id", "op", "obj", "key_str", "key_idx", "action", "value", "pred", "after").groupBy("doc_id").applyInPandas(one, "doc_id long, data binary")


def load(docs: DataFrame) -> DataFrame:
    """Operations of binary documents ``(doc_id, data)``; documents that cannot be read give no rows."""
    def run(batches):
        for b in batches:
            rows = []
            for doc, data in zip(b["doc_id"], b["data"]):
                try:
                    parsed = decode_document(data) if data is not None else None
                except FormatError:
                    continue
                for c in (parsed or {"changes": []})["changes"]:
                    rows += [(doc, o) for o in c["ops"]]
            pair = lambda x: None if x is None else {"counter": x[0], "actor": x[1]}
            field = {"bool": "b", "int": "i", "counter": "i", "timestamp": "i", "uint": "u", "double": "d", "str": "s", "bytes": "bin", "obj": "obj"}
            out = []
            for doc, o in rows:
                tag, x = o["value"]
                v = dict.fromkeys(("b", "i", "u", "d", "s", "bin", "obj")) | {"tag": tag}
                if tag in field:
                    from decimal import Decimal

                    v[field[tag]] = Decimal(x) if tag == "uint" else x
                out.append((doc, pair(o["op"]), pair(o["obj"]), o["key_str"], o["key_idx"], o["action"], v, [pair(p) for p in o["pred"]], pair(o["after"])))
            yield pd.DataFrame(out, columns=["doc_id", "op", "obj", "key_str", "key_idx", "action", "value", "pred", "after"])

    return docs.select("doc_id", "data").mapInPandas(run, OPS)


# ---------------------------------------------------------------- relational forms
def runs(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """``(by..., run, col, n)``: runs of equal values in order; null equals null."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = F.lag(order).over(w).isNull() | ~F.col(col).eqNullSafe(F.lag(col).over(w))
    tagged = df.withColumn("run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return tagged.groupBy(*by, "run").agg(F.first(col).alias(col), F.count("*").alias("n"))


def expand_runs(df: DataFrame, col: str = "v", n: str = "n") -> DataFrame:
    """Each run's value as many times as it is long."""
    return df.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(n)


def deltas(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """``df`` with ``delta``: the difference to the last value that is not null."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("delta", F.col(col) - F.coalesce(F.last(col, ignorenulls=True).over(w), F.lit(0)))


def undo_deltas(df: DataFrame, by: list[str], order: str, col: str = "delta") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.when(F.col(col).isNotNull(), F.sum(col).over(w)))


def uleb128_length(n: Column) -> Column:
    """Bytes of an unsigned number: seven bits each."""
    return F.greatest(F.ceil(F.length(F.bin(n)) / 7), F.lit(1)).cast("bigint")


def uleb128_column(n: Column) -> Column:
    """The bytes of unsigned numbers below 2**63, in built-in arithmetic."""
    width = uleb128_length(n).cast("int")
    digit = lambda k: F.shiftrightunsigned(n, 7 * k).bitwiseAND(F.lit(127).cast("long"))
    parts = [F.when(F.lit(k) < width, F.lpad(F.hex(digit(k) + F.when(F.lit(k) < width - 1, 128).otherwise(0)), 2, "0")).otherwise("") for k in range(9)]
    return F.unhex(F.concat(*parts))
