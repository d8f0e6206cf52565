import random

import pytest
from foldwright.operators.fold import AS_CODED, INTENDED, run
from foldwright.operators.inventory import Inventory
from foldwright.plans.batch import by_fold
from foldwright.sources.schema import LOG

LEAVES = [f"engine.{x}" for x in ("engine_uuid", "vehicle_uuid", "year_of_manufacture", "manufacturer", "maximum_engine_speed", "maximum_mileage_resource", "remaining_mileage_resource")]


def parent(v="V", year=2000, model="m"):
    return {"vehicle_uuid": v, "year_of_manufacture": year, "model": model, "engine": None}


def child(v="V", maker="x"):
    return {"vehicle_uuid": v, "year_of_manufacture": None, "model": None, "engine": {"engine_uuid": "E", "vehicle_uuid": v, "year_of_manufacture": 1, "manufacturer": maker, "maximum_engine_speed": 1, "maximum_mileage_resource": 1, "remaining_mileage_resource": 1}}


def ev(n, source, op, before=None, after=None, at="V"):
    return {"aggregate": at, "item": f"i{n:03d}", "source": source, "op": op, "lsn": ((n, 0, 0), (n, 0, 0)), "ts_ms": n, "before": before, "after": after}


V = ev(1, "parent", "c", None, parent())
E = ev(2, "child", "c", None, child())


def outcome(events, mode):
    _, rows = run(events, mode)
    return [(r["status"], r.get("event_type"), r.get("revision_number"), r.get("field_mask")) for r in rows]


DONE = ("processed", None, None, None)
FAIL = ("failed", None, None, None)
WAIT = ("blocked", None, None, None)


def test_parent_then_child():
    for mode in (INTENDED, AS_CODED):
        assert outcome([V, E], mode) == [DONE, ("processed", "VehicleUpdated", 1, LEAVES)]


def test_child_first():
    events = [ev(1, "child", "c", None, child()), ev(2, "parent", "c", None, parent())]
    assert outcome(events, INTENDED) == [("processed", "VehicleCreated", 1, []), ("processed", "VehicleUpdated", 2, ["year_of_manufacture", "model"])]
    assert outcome(events, AS_CODED)[1] == ("processed", "VehicleUpdated", 1, ["year_of_manufacture", "model"])


def test_child_update():
    events = [V, E, ev(3, "child", "u", child(), child(maker="y"))]
    assert outcome(events, INTENDED)[2] == ("processed", "VehicleUpdated", 2, ["engine.manufacturer"])
    assert outcome(events, AS_CODED)[2] == ("processed", "VehicleUpdated", 1, [])


def test_detach_and_remove():
    events = [V, E, ev(3, "child", "u", child(), child(None)), ev(4, "parent", "d", parent())]
    for mode, revision, parent_revision in ((INTENDED, 2, 1), (AS_CODED, 1, 0)):
        _, rows = run(events, mode)
        assert rows[2].get("event_type") is None
        assert (rows[3]["event_type"], rows[3]["revision_number"], rows[3]["vehicle_revision_number"]) == ("VehicleDeleted", revision, parent_revision)
        assert rows[3]["entity_uuid"] == ("V" if mode == INTENDED else "")


def test_unpublished_removal_says_nothing():
    assert outcome([V, ev(2, "parent", "d", parent())], INTENDED) == [DONE, DONE]


def test_removal_before_child_blocks():
    assert outcome([V, E, ev(3, "parent", "d", parent()), ev(4, "parent", "u", parent(), parent())], INTENDED)[2:] == [FAIL, WAIT]


@pytest.mark.parametrize("event", [ev(1, "parent", "u", parent(), parent()), ev(1, "parent", "d", parent()), ev(1, "child", "d", child()), ev(1, "child", "u", child(), child())])
def test_unknown_aggregate_fails(event):
    assert outcome([event], INTENDED) == [FAIL]


def test_repeated_child_event():
    again = {**E, "item": "i999"}
    assert outcome([V, E, again], INTENDED)[2] == DONE
    assert outcome([V, E, again], AS_CODED)[2] == FAIL


def test_repeated_parent_event():
    for mode in (INTENDED, AS_CODED):
        assert outcome([V, {**V, "item": "i999"}], mode) == [DONE, DONE]


def test_move_to_known_parent():
    move = ev(3, "child", "u", child("V"), child("W"), at="W")
    events = [ev(1, "parent", "c", None, parent("W"), at="W"), move]
    assert outcome(events, INTENDED)[1] == ("processed", "VehicleUpdated", 1, LEAVES)
    assert outcome(events, AS_CODED)[1] == FAIL


def test_attach_to_unknown_parent():
    assert outcome([ev(1, "child", "u", child(None), child("V"))], INTENDED) == [("processed", "VehicleUpdated", 1, [])]


def test_before_side_of_unknown_fails():
    event = ev(1, "child", "u", child("V"), child("W"))
    assert outcome([event], INTENDED) == [FAIL]
    assert outcome([event], AS_CODED)[0][1] == "VehicleUpdated"


def test_batch_fold_equals_fold_in_any_order_of_rows(spark):
    rng = random.Random(3)
    events = []
    for a in range(30):
        key = f"A{a}"
        for n in range(1, rng.randint(2, 12)):
            source, op = rng.choice(["parent", "child"]), rng.choice("ccuudr")
            image = parent(key, n) if source == "parent" else child(key, str(n))
            e = ev(n, source, op, image, image, at=key)
            events.append({**e, "item": f"{key}-{n}"})
    want = {}
    for key in {e["aggregate"] for e in events}:
        for r in run([e for e in events if e["aggregate"] == key])[1]:
            want[r["item"]] = (r["status"], r.get("event_type"), r.get("revision_number"), r.get("field_mask"))
    rng.shuffle(events)
    rows = [{**e, "lsn": {s: dict(zip(("vlf", "off", "slot"), p, strict=True)) for s, p in zip(("commit", "change"), e["lsn"], strict=True)}} for e in events]
    got = {r["item"]: (r["status"], r["event_type"], r["revision_number"], r["field_mask"]) for r in by_fold(spark.createDataFrame(rows, LOG)).collect()}
    assert got == want


def test_inventory_cascade():
    inv = Inventory()
    p = inv.add_parent(2000, "m", new_key="aaaaaaaa-0000-4000-8000-000000000001")
    inv.add_child({"VehicleUuid": p, "Manufacturer": "x"}, new_key="bbbbbbbb-0000-4000-8000-000000000001")
    inv.remove_parent(p)
    assert [(e["source"], e["op"]) for e in inv.log] == [("parent", "c"), ("child", "c"), ("child", "u"), ("parent", "d")]
    with pytest.raises(ValueError):
        inv.add_parent(1, "m", key="x", new_key=p)
    with pytest.raises(KeyError):
        inv.update_parent(p, 1, "m")


def test_stream_takes_rows_and_reads_its_state_once():
    from foldwright.streaming import stream
    from pyspark.sql import Row

    class Value:
        def __init__(self):
            self.calls, self.now = [], None

        def get(self):
            self.calls.append("get")
            return self.now

        def exists(self):
            self.calls.append("exists")
            return self.now is not None

        def update(self, new):
            self.calls.append("update")
            self.now = new

    folding = stream.Folding()
    folding.value, folding.waiting = Value(), None
    one = Row(vlf=1, off=1, slot=0)
    row = Row(aggregate="a", item="i", source="parent", op="c", lsn=Row(commit=one, change=one), ts_ms=1, before=None, after=Row(vehicle_uuid="a", year_of_manufacture=1, model="m", engine=None))
    assert [(r.item, r.status) for r in folding.handleInputRows(("a",), iter([row]), None)] == [("i", "processed")]
    assert folding.value.calls == ["get", "update"]
