"""Edits as tables of commands: what they name, what they refuse, and commits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from braidlog.functions import json as J
from braidlog.operators import dag, sequence, state, sync, write
from braidlog.schema import OP_ID, value
from braidlog.storage import cut


def log(spark, docs):
    return cut(J.import_json(spark.createDataFrame([(i, json.dumps(t)) for i, t in docs.items()], "doc_id long, json string"), "aa"))


def edit(ops, **cols):
    c = ops.select("doc_id").distinct().select("doc_id", F.lit("ww").alias("actor"), F.lit(None).cast(OP_ID).alias("obj"), F.lit(0).alias("n"))
    for k, v in cols.items():
        c = c.withColumn(k, v if not isinstance(v, (int, str)) else F.lit(v))
    return c


def exported(ops):
    return {r.doc_id: json.loads(r.json) for r in J.export_json(ops).collect()}


def test_puts_and_trees_are_exported(spark):
    ops = log(spark, {1: {"a": 1, "b": [1, [2, {"c": None}], "x\"y"]}, 2: {"a": {"k": []}}})
    tree = {"l": [1, {"m": {}}, []], "s": "é"}
    new = write.put_json(edit(ops, key_str="a", json=json.dumps(tree)), ops)
    got = exported(ops.unionByName(new))
    assert got == {1: {"a": tree, "b": [1, [2, {"c": None}], "x\"y"]}, 2: {"a": tree}}
    gone = write.delete_key(edit(ops, key_str="a"), cut(ops.unionByName(new)))
    assert exported(ops.unionByName(new).unionByName(gone)) == {1: {"b": [1, [2, {"c": None}], "x\"y"]}, 2: {}}


def test_an_object_set_into_a_list_is_exported(spark):
    ops = log(spark, {1: {"l": [1, 2]}})
    shown = sequence.visible(ops)
    at = state.get_obj_id(state.entries(ops), ["l"]).first().obj
    box = F.struct(F.lit(at.counter).cast("bigint").alias("counter"), F.lit(at.actor).alias("actor"))
    new = cut(write.set_index(edit(ops, obj=box, index=F.lit(1).cast("bigint"), value=value("obj", F.lit("map"))), ops, shown))
    made = F.struct(F.lit(new.first().op.counter).cast("bigint").alias("counter"), F.lit("ww").alias("actor"))
    inner = write.put(edit(ops, obj=made, key_str="k", value=value("int", F.lit(5))), cut(ops.unionByName(new)))
    assert exported(ops.unionByName(new).unionByName(inner)) == {1: {"l": [1, {"k": 5}]}}


@pytest.mark.parametrize("make", [
    lambda ops, shown: write.increment(edit(ops, key_str="a", delta=1), ops),
    lambda ops, shown: write.set_index(edit(ops, index=F.lit(9).cast("bigint"), value=value("null")), ops, shown),
    lambda ops, shown: write.delete_index(edit(ops, index=F.lit(0).cast("bigint")), ops, shown)])
def test_edits_of_what_is_not_there_stop(spark, make):
    ops = log(spark, {1: {"a": 1}})
    with pytest.raises(Exception, match="no (counter|element) at"):
        make(ops, sequence.visible(ops)).collect()


def test_no_operations_no_change(spark):
    ops = log(spark, {1: {"a": 1}})
    changes = spark.createDataFrame([(1, 1, "aa", 1, [])], "doc_id long, id long, actor string, seq long, deps array<long>")
    assert write.commit(write.delete_key(edit(ops, key_str="a"), ops).limit(0), changes, "ww").collect() == []


def graph(rng, n):
    """Changes with random dependencies; some actors skip their own last change."""
    out, seqs, last = [], {}, {}
    for k in range(1, n):
        a = rng.choice("xyz")
        deps = {rng.randrange(1, k) for _ in range(rng.randrange(3))} if k > 1 else set()
        if a in last and rng.random() < 0.9:
            deps.add(last[a])
        seqs[a] = seqs.get(a, 0) + 1
        last[a] = k
        out.append((k, a, seqs[a], sorted(deps)))
    return out


def test_closures_equal_brute_force(spark):
    rng, rows, want, back, of = random.Random(3), [], set(), set(), []
    for doc in range(12):
        g = graph(rng, 40)
        if doc % 2:  # every change depends on its actor's last one
            last, whole = {}, []
            for k, a, n, d in g:
                whole.append((k, a, n, sorted({*d, *([last[a]] if a in last else [])})))
                last[a] = k
            g = whole
        deps = {k: d for k, _, _, d in g}
        start = rng.randrange(10, 39)
        of.append((doc, start))
        for found, step in ((want, lambda k: deps[k]), (back, lambda k: [x for x, d in deps.items() if k in d])):
            stack = [start]
            while stack:
                k = stack.pop()
                if (doc, k) not in found:
                    found.add((doc, k))
                    stack += step(k)
        rows += [(doc, k, a, s, d) for k, a, s, d in g]
    df = spark.createDataFrame(rows, "doc_id long, id long, actor string, seq long, deps array<long>")
    at = spark.createDataFrame(of, "doc_id long, id long")
    assert {tuple(r) for r in dag.ancestors(df, at, cut).collect()} == want
    assert {tuple(r) for r in dag.ancestors(df, at, cut, reverse=True).collect()} == back


def test_what_a_filter_hides_comes_in_a_second_round(spark, monkeypatch):
    """One bit an entry: filters say yes to much that a peer does not have."""
    monkeypatch.setattr(sync, "BITS_PER_ENTRY", 1)
    rows = [(1, k, "x" if k % 2 else "y", (k + 1) // 2, [k - 2] if k > 2 else []) for k in range(1, 41)]
    g = spark.createDataFrame(rows, "doc_id long, id long, actor string, seq long, deps array<long>")
    a, b, rounds = sync.synchronise(g.where("actor = 'x' or id <= 6"), g.where("actor = 'y' or id <= 3"), cut)
    assert a.count() == b.count() == 40 and rounds > 1
    assert sync.synchronise(a, b, cut)[2] == 0


def test_probes_in_sql_are_those_of_the_format(spark):
    hashes = [f"{k:064x}"[::-1] for k in range(1, 60)]
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    got = {r.h: sorted(set(r.p)) for r in df.select("h", sync._positions(F.col("h"), F.lit(800)).alias("p")).collect()}
    assert got == {h: sorted(set(p)) for h, p in zip(hashes, sync.probes(hashes, 800).tolist())}
    f = sync.filter_bytes(sync.build_filters(df.withColumn("d", F.lit(1)).withColumnRenamed("h", "hash"), ["d"]), ["d"]).first().bits
    assert bytes(f) == sync.filter_bits(hashes)
