import json

from foldwright.operators import routing
from foldwright.sources.envelope import decode
from foldwright.sources.schema import CHILD_ROW, MESSAGE, PARENT_ROW

V1 = "AAAAAAAA-0000-4000-8000-000000000001"
V2 = "AAAAAAAA-0000-4000-8000-000000000002"
KEY = json.dumps({"payload": {"VehicleUuid": V1}})


def value(op, before=None, after=None, commit="0000002A:00000D80:0005", change="0000002A:00000D80:0003", name="payload"):
    return json.dumps({name: {"before": before, "after": after, "op": op, "ts_ms": 2, "source": {"change_lsn": change, "commit_lsn": commit, "ts_ms": 1}}})


def parent(v=V1):
    return {"VehicleUuid": v, "YearOfManufacture": 2020, "Model": "m"}


def child(v):
    return {"EngineUuid": "BBBBBBBB-0000-4000-8000-000000000001", "VehicleUuid": v, "YearOfManufacture": 1, "Manufacturer": "x"}


def messages(spark, rows):
    return spark.createDataFrame([("t", 0, i, 5, k, v, None) for i, (k, v) in enumerate(rows)], MESSAGE)


def test_rules(spark):
    cases = [
        (KEY, value("c", None, parent()), None),
        (KEY, value("R", {}, parent(), change=None), None),
        (KEY, value("c", None, parent(), name="Payload"), None),
        (KEY, None, None),
        (KEY, "  ", None),
        (KEY, value("c", parent(), parent()), "wrong images for the operation"),
        (KEY, value("u", None, parent()), "wrong images for the operation"),
        (KEY, value("u", {}, parent()), "wrong images for the operation"),
        (KEY, value("d", parent(), parent()), "wrong images for the operation"),
        (KEY, value("x", None, parent()), "unknown operation"),
        (KEY, value(None, None, parent()), "unknown operation"),
        (KEY, value("c", None, parent(), commit=""), "bad commit number"),
        (KEY, value("c", None, parent(), change="q"), "bad change number"),
        (KEY, "{", "malformed json"),
        (None, value("c", None, parent()), "no key"),
        ('{"payload":{"a":"b"}}', value("c", None, parent()), "malformed key"),
        ('{"payload":{"a":"b","c":"d"}}', value("c", None, parent()), None),
    ]
    good, bad = decode(messages(spark, [c[:2] for c in cases]), PARENT_ROW)
    errors = {r["offset"]: r["error"] for r in bad.collect()}
    rows = {r["offset"]: r for r in good.collect()}
    assert {i: c[2] for i, c in enumerate(cases) if c[2]} == errors
    assert set(rows) | set(errors) == set(range(len(cases)))
    assert rows[0]["key_id"] == V1.lower() and tuple(rows[0]["lsn"]["change"]) == (42, 3456, 3) and tuple(rows[0]["lsn"]["commit"]) == (42, 3456, 5)
    assert rows[1]["lsn"]["change"] == rows[1]["lsn"]["commit"] and rows[1]["op"] == "r" and rows[1]["before"] is None
    assert rows[3]["tombstone"] and rows[4]["tombstone"] and rows[16]["key_id"] == "00000000-0000-0000-0000-000000000000"


def test_fan_out(spark):
    cases = [("c", None, child(None)), ("u", child(V1), child(V2)), ("u", child(V1), child(V1)), ("u", child(None), child(V2)), ("d", child(V1), None)]
    good, bad = decode(messages(spark, [(KEY, value(*c)) for c in cases] + [(KEY, None)]), CHILD_ROW)
    assert bad.count() == 0
    got = {}
    for r in routing.work_items(good, {"t": routing.child_key}).orderBy("offset", "position").collect():
        got.setdefault(r["offset"], []).append(r["aggregate"])
    assert got == {1: [V1.lower(), V2.lower()], 2: [V1.lower()], 3: [V2.lower()], 4: [V1.lower()]}
