import copy

import pytest
from hypothesis import given
from hypothesis import strategies as st

from braidlog.functions import json as J

trees = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab~/", max_size=3),
                     lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab~/01", max_size=2), x, max_size=3), max_leaves=12)
objects = st.dictionaries(st.text("ab", max_size=2), trees, max_size=3)


def test_pointers():
    d = {"up/down": "u", "t~t": "t", "rows": [[5], {"col": 6}], "": "none"}
    for p, v in (("/up~1down", "u"), ("/t~0t", "t"), ("/rows/0/0", 5), ("/rows/1/col", 6), ("/", "none"), ("", d)):
        assert J.resolve(d, J.parse_pointer(p)) == v
    for p in ("/rows/7", "/rows/00", "/rows/-", "/rows/1/none"):
        assert J.resolve(d, J.parse_pointer(p)) is J.MISSING
    with pytest.raises(J.PatchError):
        J.parse_pointer("rows")


def test_patch_operations():
    d = {"a": 1, "items": [1, 2]}
    steps = [{"op": "add", "path": "/items/-", "value": 3}, {"op": "move", "from": "/a", "path": "/b"}, {"op": "copy", "from": "/b", "path": "/c"},
             {"op": "replace", "path": "/items/0", "value": 9}, {"op": "remove", "path": "/items/1"}, {"op": "test", "path": "/c", "value": 1}]
    assert J.apply_patch(d, steps) == {"b": 1, "c": 1, "items": [9, 3]} and d == {"a": 1, "items": [1, 2]}
    for bad in ([{"op": "test", "path": "/a", "value": 2}], [{"op": "?", "path": ""}], {}, [{"op": "add", "path": "/x/y", "value": 1}]):
        with pytest.raises(J.PatchError):
            J.apply_patch(d, bad)


@given(trees, trees)
def test_diff_round_trip(a, b):
    before = copy.deepcopy(a)
    assert J.same(J.apply_patch(a, J.diff(a, b)), b) and J.same(a, before)


def no_nulls(x):
    if isinstance(x, dict):
        return {k: no_nulls(v) for k, v in x.items() if v is not None}
    return x


@given(objects, objects)
def test_merge_patch_round_trip(a, b):
    a, b = no_nulls(a), no_nulls(b)
    assert J.same(J.merge(a, J.difference(a, b)), b)


def test_merge_patch_keeps_nulls_in_new_objects_unless_rfc():
    assert J.merge({"keep": "k", "drop": "d", "swap": [1]}, {"swap": {"in": True}, "drop": None}) == {"keep": "k", "swap": {"in": True}}
    assert J.merge({}, {"new": {"gone": None}}, rfc=False) == {"new": {"gone": None}} and J.merge({}, {"new": {"gone": None}}) == {"new": {}}


def test_flatten_and_unflatten():
    d = {"tree": {"left": {"leaf": -7}, "right": {}}, "row": ["p", False]}
    flat = dict(J.leaves(d))
    assert flat == {"/tree/left/leaf": -7, "/row/0": "p", "/row/1": False}
    assert J.unflatten_tree(flat) == {"tree": {"left": {"leaf": -7}}, "row": {"0": "p", "1": False}} and J.unflatten_tree(flat, lists=True)["row"] == ["p", False]


def test_put_and_delete_pointer():
    assert J.put_at({}, ["a", "b"], 1) == {"a": {"b": 1}} and J.put_at({"l": [1]}, ["l", "-"], 2) == {"l": [1, 2]} and J.put_at({"l": [1]}, ["l", "0"], 2) == {"l": [2]}
    assert J.delete_at({"a": 1}, ["x", "y"]) == {"a": 1}


def test_import_export_round_trip(spark):
    from braidlog.operators import state

    rows = [(1, '{"a":1,"m":{"x":"q\\"","n":null,"deep":{"t":true}},"e":{}}'), (2, "{}"), (3, None)]
    ops = J.import_json(spark.createDataFrame(rows, "doc_id long, json string"), "a0")
    import json

    got = {r.doc_id: json.loads(r.json) for r in J.export_maps(state.winners(state.entries(ops))).collect()}
    assert got == {1: json.loads(rows[0][1])}
