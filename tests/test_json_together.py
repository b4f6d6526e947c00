"""Documents folded where their rows stand against the fold by rounds."""

import json
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import braidlog.queries as Q
from braidlog.functions import json as J
from braidlog.schema import OPS
from braidlog.storage import cut

DIR = "/root/testdata/sf0.001"
FIELD = {"bool": "b", "int": "i", "str": "s", "obj": "obj", "bytes": "bin", "double": "d"}


def row(doc, op, obj, action, val=("null", None), key=None, pred=(), after=None):
    v = dict.fromkeys(("b", "i", "u", "d", "s", "bin", "obj")) | {"tag": val[0]} | ({FIELD[val[0]]: val[1]} if val[0] in FIELD else {})
    pair = lambda x: None if x is None else {"counter": x[0], "actor": x[1]}
    return (doc, pair(op), pair(obj), key, None, action, v, [pair(p) for p in pred], pair(after))


def edited(doc: int, seed: int, n: int) -> list[tuple]:
    """Edits by three actors: conflicts, deletes, objects in lists, concurrent inserts, texts, origins that are not there."""
    rng = random.Random(seed)
    boxes, puts, elems, out = [(None, "map")], {}, {}, []
    for c in range(1, n + 1):
        op, (obj, kind) = (c, rng.choice("abé")), rng.choice(boxes)
        val = rng.choice([("int", c), ("str", f'x"\n\x1f{c}é'), ("null", None), ("bool", True), ("bytes", b"ab"), ("double", 0.5)] + [("obj", k) for k in ("map", "list", "text", "table")])
        if kind in ("map", "table"):
            key = rng.choice(["a", "b", "é", '"q', "\x01", "😀", "￿"])
            at = puts.setdefault((obj, key), [])
            pred = rng.sample(at, rng.randint(0, len(at)))
            if rng.random() < 0.2:
                out.append(row(doc, op, obj, "del", key=key, pred=pred))
                continue
            out.append(row(doc, op, obj, "make_object" if val[0] == "obj" else "put", val, key, pred))
            at.append(op)
        else:
            at, step = elems.setdefault(obj, []), rng.random()
            if at and step < 0.2:
                out.append(row(doc, op, obj, "del", pred=[rng.choice(at)]))
                continue
            if at and step < 0.4:
                out.append(row(doc, op, obj, "make_object" if val[0] == "obj" else "put", val, pred=[rng.choice(at)]))
            else:
                after = (10**6 + c, "z") if rng.random() < 0.05 else at[-1] if at and rng.random() < 0.6 else rng.choice([None, *at])
                out.append(row(doc, op, obj, "insert", val, after=after))
                at.append(op)
        if val[0] == "obj":
            boxes.append((op, val[1]))
    out.append(row(doc, (n + 1, "a"), None, "increment", ("int", 1), "a"))
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, OPS)


def both(ops):
    """The export by rounds, and together."""
    ops = cut(ops)
    want = sorted((r.doc_id, r.json) for r in J.export_json(ops).collect())
    return want, sorted((r.doc_id, r.json) for r in J.export_together(J.together(ops)).collect())


def test_edited_documents_are_as_by_rounds(spark):
    rows = [r for d in range(40) for r in edited(d, d, 5 + 3 * d)]
    want, got = both(frame(spark, rows))
    assert got == want and len(got) == 40


@pytest.mark.parametrize("most", [0, 20])
def test_large_and_odd_documents_go_by_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(J, "FOLD_OPS", most)
    twice = edited(3, 7, 30)
    rows = edited(1, 1, 15) + edited(2, 2, 60) + twice + twice[:4]
    ops = frame(spark, rows).dropDuplicates(["doc_id", "op"]).unionByName(frame(spark, [row(4, (1, "a"), None, "put", ("int", None), "k"), row(4, (2, "a"), None, "put", ("int", 1), "j")]))
    want, got = both(ops)
    assert got == want and [d for d, _ in got] == [1, 2, 3, 4]


def test_a_document_may_span_batches_and_rows(spark):
    docs = [(d % 3, json.dumps({f"k{i}": [i, {"z": []}] for i in range(3)})) for d in range(6)]
    ops = J.import_json(spark.createDataFrame(docs, "doc_id long, json string"), "a").dropDuplicates(["doc_id", "op"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        want, got = both(ops)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == 3


def test_an_import_by_columns_has_the_rows_of_its_trees(spark):
    trees = [{"a": [1, [2.5, {"b": None}], "x", []], "u": 2**63, "t": True, "n": -(2**63), "big": 2**70, "é": {"": {}}}, {}, [1], 5, {"k": "v"}]
    docs = spark.createDataFrame([(d, json.dumps(t)) for d, t in enumerate(trees)] + [(9, None)], "doc_id long, json string")
    want = spark.createDataFrame([J._log_row(d, o) for d, t in enumerate(trees) for o in J.tree_ops(t, "aa")], OPS)
    got = J.import_json(docs, "aa")
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_nested_export_keeps_no_operation(spark, monkeypatch):
    """Only finished documents are kept; the log is neither cut nor shuffled."""
    kept = []
    monkeypatch.setattr(J, "cut", lambda df: kept.append(df.columns) or cut(df))
    df = Q.json_export_nested(spark, DIR)
    assert kept == [["doc_id", "json"]] and df.count() == spark.read.parquet(f"{DIR}/events.parquet").count()
