"""The assembled engine, the envelope's two forms, and streams that stop, go on and retry."""

import json
import threading

from foldwright.functions import wire
from foldwright.operators import fold, outbox
from foldwright.operators.inventory import Inventory
from foldwright.plans import batch
from foldwright.plans.service import Aggregator
from foldwright.sources.schema import CHANGE, LOG, MESSAGE
from foldwright.streaming import stream
from pyspark.sql import functions as F

ID = "00000000-0000-4000-8000-{:012d}"


def messages(spark, log, first=0):
    rows = []
    for e in log:
        n = e["n"]
        lsn = f"0000002a:{n:08x}:0001"
        payload = {"before": e["before"], "after": e["after"], "op": e["op"], "ts_ms": n, "source": {"change_lsn": lsn, "commit_lsn": lsn, "ts_ms": n * 10}}
        row = e["after"] or e["before"]
        key = {"payload": {"id": row["EngineUuid"] if e["source"] == "child" else row["VehicleUuid"]}}
        rows.append((e["source"], 0, n, n * 10, json.dumps(key), json.dumps({"payload": payload}), None))
    return spark.createDataFrame(rows[first:], MESSAGE)


def inventory():
    inv = Inventory()
    v = inv.add_parent(2020, "m", new_key=ID.format(1))
    child = {"YearOfManufacture": 1, "Manufacturer": "x", "MaximumEngineSpeed": 10, "MaximumMileageResource": 20, "RemainingMileageResource": 5}
    c = inv.add_child({**child, "VehicleUuid": v}, new_key=ID.format(2))
    inv.update_parent(v, 2021, "n")
    inv.update_child(c, {**child, "VehicleUuid": v, "Manufacturer": "y"})
    inv.add_parent(1999, "", new_key=ID.format(3))
    inv.remove_parent(v)
    return inv


def test_aggregator_from_messages_to_topic(spark, tmp_path):
    log, sent = inventory().log, []
    engine = Aggregator(spark, str(tmp_path / "a"), lambda m, n: sent.extend(m.orderBy("item").collect()), parents="parent", children="child", batch_size=5)
    bad = spark.createDataFrame([("parent", 0, 900, 1, None, "{", None)], MESSAGE)
    assert engine.ingest(messages(spark, log).unionByName(bad), 0) == len(log)
    assert engine.ingest(messages(spark, log).unionByName(bad), 0) == 0  # comes again
    assert [r["error"] for r in spark.read.parquet(f"{engine.root}/rejects").collect()] == ["no key"]
    stop, clock = threading.Event(), 1000
    worker = engine.run_sequentially(lambda: clock, stop, [lambda what, value: stop.set() if what == "batch" and value == 0 else None])
    assert worker.errors == 0
    values = sorted((json.loads(r["value"]) for r in sent), key=lambda v: (v["entityUuid"], v["revisionNumber"]))
    whole = "engine.engineUuid,engine.vehicleUuid,engine.yearOfManufacture,engine.manufacturer,engine.maximumEngineSpeed,engine.maximumMileageResource,engine.remainingMileageResource"
    want = [("VehicleUpdated", 1, whole), ("VehicleUpdated", 2, "yearOfManufacture,model"), ("VehicleUpdated", 3, "engine.manufacturer"), ("VehicleDeleted", 4, None)]
    assert [(v["event"]["@type"].rpartition(".")[2], v["revisionNumber"], v["event"].get("fieldMask")) for v in values] == want
    assert values[1]["resultingState"]["model"] == "n" and values[2]["resultingState"]["engine"]["manufacturer"] == "y" and values[-1]["event"]["vehicleRevisionNumber"] == 3
    left = {r["aggregate"] for r in engine.store.read("states").collect()}
    assert left == {ID.format(3)}  # what is gone leaves no state
    assert engine.store.read("items").where("processed_at IS NULL").count() == 0
    engine.purge(2000)
    assert engine.store.read("items").count() == 0 and engine.store.read("outbox").count() == 0


def test_a_late_event_ends_the_delay(spark, tmp_path):
    log = inventory().log[:3]
    engine = Aggregator(spark, str(tmp_path / "a"), lambda m, n: None, parents="parent", children="child")
    engine.ingest(messages(spark, log, first=2), 0)  # an update of what isn't there yet
    assert engine.project(1000) == 0
    item = engine.store.read("items").first()
    assert item["retry_counter"] == 1 and item["next_retry"] > 1000 and engine.project(1001) == 0
    engine.ingest(messages(spark, log).limit(2), 1)
    assert engine.project(10**9) == 3 and engine.publish(10**9) == 2


def test_wire_form(spark):
    assert wire.varint(300) == b"\xac\x02"
    # a message by hand: field 1 text, field 5 number
    assert wire.encode("Change", {"entity_uuid": "ab", "revision_number": 150}, "p") == b"\x0a\x02ab\x28\x96\x01"
    assert wire.encode("Engine", {"engine_uuid": "", "vehicle_uuid": None, "manufacturer": ""}, "p") == b"\x0a\x00"
    rows = [fold.Runner().waits({"aggregate": "a", "item": "i"})]
    state = {"vehicle_uuid": "a", "year_of_manufacture": 0, "model": "é", "engine": {"engine_uuid": "", "vehicle_uuid": None, "year_of_manufacture": -5, "manufacturer": "", "maximum_engine_speed": 2**31 - 1, "maximum_mileage_resource": 0, "remaining_mileage_resource": 1}}
    for kind in ("VehicleCreated", "VehicleUpdated", "VehicleDeleted"):
        gone = kind == "VehicleDeleted"
        rows.append({"aggregate": "a", "item": kind, "status": "processed", "error": None, "entity_uuid": "a", "changed_at_ms": 1_234_567, "event_type": kind, "revision_number": 3, "vehicle_revision_number": 2 if gone else None, "field_mask": ["model", "engine.manufacturer"] if kind == "VehicleUpdated" else [], "resulting_state": None if gone else state})
    df = spark.createDataFrame([tuple(r.get(c) for c in CHANGE.names) for r in rows], CHANGE)
    out = {r["item"]: r for r in df.select("item", F.struct(*CHANGE.names).alias("own"), wire.encoded(F.struct(*CHANGE.names)).alias("data")).withColumn("back", wire.decoded(F.col("data"))).collect()}
    assert out["i"]["data"] is None and out["i"]["back"]["event_type"] is None
    for kind in ("VehicleCreated", "VehicleUpdated", "VehicleDeleted"):
        own, back = (out[kind][c].asDict(recursive=True) for c in ("own", "back"))
        assert back == {c: own[c] for c in back}
    assert wire._read(b"\xff")["event_type"] is None


def test_json_form(spark):
    state = "named_struct('vehicle_uuid', 'a', 'year_of_manufacture', 0, 'model', '', 'engine', named_struct('engine_uuid', '', 'vehicle_uuid', cast(null as string), 'year_of_manufacture', 7, 'manufacturer', 'x', 'maximum_engine_speed', 0, 'maximum_mileage_resource', 0, 'remaining_mileage_resource', 0))"
    mask = F.array(F.lit("model"), F.lit("engine.maximum_engine_speed"))
    text = outbox.change_json(F.lit("VehicleUpdated"), F.expr(state), F.lit(2), F.lit(None).cast("long"), F.lit(1500).cast("long"), F.lit("a"), mask, package="p")
    got = json.loads(spark.range(1).select(text.alias("t")).first()["t"])
    document = {"vehicleUuid": "a", "engine": {"engineUuid": "", "yearOfManufacture": 7, "manufacturer": "x"}}
    assert got == {"entityUuid": "a", "changedAt": "1970-01-01T00:00:01.500Z", "revisionNumber": 2, "event": {"@type": "type.googleapis.com/p.VehicleUpdated", "vehicle": document, "fieldMask": "model,engine.maximumEngineSpeed"}, "resultingState": {"@type": "type.googleapis.com/p.Vehicle", **document}}


def _log(spark, rows):
    """(item number, op): parent events of one aggregate in order of the number."""
    none = "cast(null as struct<engine_uuid:string,vehicle_uuid:string,year_of_manufacture:int,manufacturer:string,maximum_engine_speed:int,maximum_mileage_resource:int,remaining_mileage_resource:int>)"
    df = spark.createDataFrame(rows, "n long, op string")
    row = F.expr(f"named_struct('vehicle_uuid', 'a', 'year_of_manufacture', cast(n as int), 'model', 'm', 'engine', {none})")
    part = F.struct(F.col("n").alias("vlf"), F.lit(0).cast("long").alias("off"), F.lit(0).cast("long").alias("slot"))
    out = df.select(F.lit("a").alias("aggregate"), F.col("n").cast("string").alias("item"), F.lit("parent").alias("source"), "op", F.struct(part.alias("commit"), part.alias("change")).alias("lsn"), F.col("n").alias("ts_ms"), row.alias("before"), row.alias("after"))
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG.fields))


def test_stream_goes_on_after_a_stop_and_an_early_event_frees_what_waits(spark, tmp_path):
    stream.prepare(spark)
    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))
    seen = []
    for rows in ([(5, "u"), (6, "u")], [(7, "u")], [(1, "c")], [(8, "u")]):
        _log(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream.run_available(stream.changes_stream(spark.readStream.schema(LOG).parquet(source)), out, state)
        got = sorted((r["item"], r["status"]) for r in spark.read.schema(CHANGE).parquet(out).collect())
        seen.append([x for x in got if x not in [y for s in seen for y in s]])
    assert seen == [[("5", "failed"), ("6", "blocked")], [("7", "blocked")], [("1", "processed"), ("5", "processed"), ("6", "processed"), ("7", "processed")], [("8", "processed")]]


def test_batch_states_go_on(spark):
    rows = [(1, "c"), (2, "u"), (3, "u"), (4, "u")]
    none = spark.createDataFrame([], "aggregate string, state string")
    first = batch.by_fold(_log(spark, rows[:2]), states=none).collect()
    states = spark.createDataFrame([(r["aggregate"], r["error"]) for r in first if r["status"] == "state"], "aggregate string, state string")
    again = batch.by_fold(_log(spark, rows[1:]), states=states).collect()
    assert [r["status"] for r in again] == ["processed"] * 3 + ["state"]
    assert json.loads(again[-1]["error"])["revision"] == 4  # the repeated event counts once


def test_stream_asks_for_its_state_once_a_bucket(spark, tmp_path):
    """Aggregates of a bucket share one read and one write of the state, and one timer where theirs are equal."""

    class Held:
        def __init__(self):
            self.calls, self.now = [], None

        def get(self):
            self.calls.append("get")
            return self.now

        def update(self, new):
            self.calls.append("update")
            self.now = new

        def clear(self):
            self.calls.append("clear")
            self.now = None

    class Handle:
        timers = set()

        def getValueState(self, *a):  # noqa: N802
            return held

        def registerTimer(self, ms):  # noqa: N802
            self.timers.add(ms)

        def deleteTimer(self, ms):  # noqa: N802
            self.timers.discard(ms)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return self.ms

        getExpiryTimeInMs = getCurrentProcessingTimeInMs  # noqa: N815

    held, folding = Held(), stream.Bucketed()
    folding.init(Handle())
    log = [r.asDict(recursive=True) for r in _log(spark, [(1, "c"), (2, "u"), (3, "d")]).collect()]
    feed = lambda ms, *events: [json.loads(r.change) for r in folding.handleInputRows((1,), iter([{"event": json.dumps(e | {"aggregate": a})} for a, e in events]), Clock(ms))]
    assert [(r["aggregate"], r["status"]) for r in feed(0, ("a", log[1]), ("b", log[1]), ("c", log[0]))] == [("a", "failed"), ("b", "failed"), ("c", "processed")]
    assert held.calls == ["get", "update"] and len(Handle.timers) == 1
    (at,) = Handle.timers
    assert [r["status"] for r in feed(1, ("a", log[0]))] == ["processed"] * 2 and Handle.timers == {at}  # b still waits
    Handle.timers.clear()
    assert not list(folding.handleExpiredTimer((1,), Clock(at), Clock(at))) and len(Handle.timers) == 1
    feed(2, ("a", log[2]), ("c", log[2]), ("b", log[0]))
    assert [r["status"] for r in feed(3, ("b", log[2]))] == ["processed"] and held.now is None and not Handle.timers
