"""Random concurrent histories: set-based plans against one-by-one replay, and the merge laws."""

import random

import pytest

from braidlog.operators import merge, sequence, state
from braidlog.schema import OPS

VALUE = dict.fromkeys(("b", "i", "u", "d", "s", "bin", "obj"))


def history(seed: int, n: int = 120):
    """Three replicas that edit a map, a counter key and a list, and sometimes read each other."""
    rng = random.Random(seed)
    logs = {a: [] for a in "xyz"}
    for _ in range(n):
        a = rng.choice("xyz")
        if rng.random() < 0.2:
            seen = {o["op"] for o in logs[a]}
            logs[a] += [o for o in logs[rng.choice("xyz")] if o["op"] not in seen]
            continue
        counter = max((o["op"][0] for o in logs[a]), default=0) + 1
        live, order = replay(logs[a])
        base = {"op": (counter, a), "key_str": None, "pred": [], "after": None, "i": rng.randrange(100), "tag": "int"}
        if rng.random() < 0.5:
            k = rng.choice("pq")
            act = rng.choice(["put", "put", "del", "increment"])
            base |= {"key_str": k, "action": act, "pred": sorted(live.get(k, {})), "tag": "counter"}
        else:
            act = rng.choice(["insert", "insert", "insert", "put", "del"])
            if act == "insert":
                base |= {"action": act, "after": rng.choice(order)[0] if order and rng.random() < 0.8 else None}
            elif order:
                base |= {"action": act, "pred": [rng.choice(order)[0]]}
            else:
                continue
        logs[a].append(base)
    return logs


def replay(log):
    """Map entries by key, and the visible list, from one pass in the order of ids."""
    live, elems, dead, sets = {}, {}, set(), {}
    for o in sorted(log, key=lambda o: o["op"]):
        at = live.setdefault(o["key_str"], {})
        if o["key_str"] is not None:
            if o["action"] in ("put", "del"):
                for p in o["pred"]:
                    at.pop(p, None)
            if o["action"] == "put":
                at[o["op"]] = o["i"]
            if o["action"] == "increment":
                for p in o["pred"]:
                    if p in at:
                        at[p] += o["i"]
        elif o["action"] == "insert":
            elems[o["op"]] = o
        elif o["action"] == "del":
            dead |= set(o["pred"])
        else:
            for p in o["pred"]:
                sets[p] = o["i"]
    kids: dict = {}
    for e, o in elems.items():
        kids.setdefault(o["after"], []).append(e)
    out, stack = [], sorted(kids.get(None, []))
    while stack:
        e = stack.pop()
        out.append(e)
        stack += sorted(kids.get(e, []))
    return live, [(e, sets.get(e, elems[e]["i"])) for e in out if e not in dead]


def frame(spark, logs):
    pair = lambda x: None if x is None else {"counter": x[0], "actor": x[1]}
    rows = [(doc, pair(o["op"]), None, o["key_str"], None, o["action"], VALUE | {"tag": o["tag"], "i": o["i"]}, [pair(p) for p in o["pred"]], pair(o["after"]))
            for doc, log in logs for o in log]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, OPS)


def shown(ops):
    c = {(r.doc_id, r.key_str, r.op.counter, r.op.actor): r.v for r in state.counters(ops, state.entries(ops)).collect()}
    v = {(r.doc_id, r.idx): (r.elem.counter, r.elem.actor, r.value.i) for r in sequence.visible(ops).collect()}
    return c, v


def test_plans_equal_replay(spark):
    logs = []
    for seed in range(25):
        h = history(seed)
        whole = {o["op"]: o for a in h.values() for o in a}
        logs.append((seed, list(whole.values())))
    got = shown(frame(spark, logs))
    counters, values = {}, {}
    for doc, log in logs:
        live, order = replay(log)
        counters |= {(doc, k, *op): v for k, at in live.items() if k is not None for op, v in at.items()}
        values |= {(doc, i): (*e, v) for i, (e, v) in enumerate(order)}
    assert got == (counters, values)


def test_merge_laws(spark):
    h = [history(s) for s in range(4)]
    a, b, c = (frame(spark, [(s, x[k]) for s, x in enumerate(h)]) for k in "xyz")
    both = shown(merge.merge(a, b))
    assert both == shown(merge.merge(b, a)) == shown(merge.merge(a, b, b, a))
    assert shown(merge.merge(merge.merge(a, b), c)) == shown(merge.merge(a, merge.merge(b, c)))
    assert shown(merge.merge(a, a.limit(0))) == shown(a)


def test_long_chain_and_front_inserts(spark):
    chain = [{"op": (k, "x"), "key_str": None, "action": "insert", "after": (k - 1, "x") if k > 1 else None, "pred": [], "i": k, "tag": "int"} for k in range(1, 3001)]
    front = [o | {"after": None} for o in chain[:500]]
    _, v = shown(frame(spark, [(1, chain), (2, front)]))
    assert [v[1, i][0] for i in range(3000)] == list(range(1, 3001)) and [v[2, i][0] for i in range(500)] == list(range(500, 0, -1))
