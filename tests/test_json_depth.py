import json


def test_export_of_maps_nested_more_than_eight_deep(spark):
    from braidlog.functions import json as J
    from braidlog.operators import state

    deep = {"end": 1, "e": {}}
    for k in range(11):
        deep = {f"k{k}": deep, "v": k}
    rows = [(1, json.dumps(deep)), (2, '{"a":{"b":2}}'), (3, '{"a":1}')]
    ops = J.import_json(spark.createDataFrame(rows, "doc_id long, json string"), "a0")
    got = {r.doc_id: json.loads(r.json) for r in J.export_maps(state.winners(state.entries(ops))).collect()}
    assert got == {i: json.loads(t) for i, t in rows}
