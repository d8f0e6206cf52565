import pytest
from foldwright.functions import fieldmask, lsn, scalars
from foldwright.functions.backoff import IDLE, RETRY
from foldwright.sources.schema import DOCUMENT
from pyspark.sql import functions as F

ENGINE = {"engine_uuid": "e", "vehicle_uuid": "v", "year_of_manufacture": 1, "manufacturer": "m", "maximum_engine_speed": 2, "maximum_mileage_resource": 3, "remaining_mileage_resource": 4}
LEAVES = [f"engine.{k}" for k in ENGINE]


def doc(engine=None, model=None, year=None):
    return {"vehicle_uuid": "v", "year_of_manufacture": year, "model": model, "engine": engine}


def test_lsn(spark):
    rows = [("0000002A:00000D80:0003", (42, 3456, 3)), ("0:0:0", (0, 0, 0)), ("1:2", None), ("zz:0:0", None), ("", None), (None, None), ("ffffffffffffffff:0:0", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(lsn.parse(F.col("t")).alias("p"))
    assert [r["p"] and tuple(r["p"]) for r in df.collect()] == [w for _, w in rows]
    one = spark.range(1).select(lsn.parse(F.lit("0000002a:00000d80:0003")).alias("p")).select(lsn.render(F.col("p")).alias("t"), (F.col("p") < lsn.parse(F.lit("2b:0:0"))).alias("less")).first()
    assert (one["t"], one["less"]) == ("2a:d80:3", True)
    with pytest.raises(Exception, match="not a log sequence number"):
        spark.range(1).select(lsn.parse_strict(F.lit("1:2"))).collect()


def test_blank_change_number_is_the_commit_number(spark):
    p = spark.range(1).select(lsn.pair(F.lit("1:2:3"), F.lit(" ")).alias("p")).first()["p"]
    assert tuple(p["commit"]) == tuple(p["change"]) == (1, 2, 3)


def test_backoff(spark):
    assert [RETRY.delay(a) for a in (1, 2, 3, 4, 13, 14, 30)] == [20_000, 40_000, 80_000, 160_000, 81_920_000, 86_400_000, 86_400_000]
    assert [IDLE.delay(a) for a in range(1, 5)] == [2000, 4000, 5000, 5000]
    got = spark.range(40).select(RETRY.column(F.col("id")).alias("r"), IDLE.column(F.col("id")).alias("i")).collect()
    assert [(r["r"], r["i"]) for r in got] == [(RETRY.delay(a), IDLE.delay(a)) for a in range(40)]


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        (doc(), doc(ENGINE), LEAVES),
        (doc(ENGINE), doc(), ["engine"]),
        (doc(ENGINE), doc({**ENGINE, "manufacturer": "x"}), ["engine.manufacturer"]),
        (doc(ENGINE), doc(ENGINE, "m", 2000), ["year_of_manufacture", "model"]),
        (doc(ENGINE), doc(ENGINE), []),
        (doc(year=None), doc(year=0), []),
        (doc(model=None), doc(model=""), ["model"]),
    ],
)
def test_field_mask(spark, old, new, want):
    assert fieldmask.diff(old, new, DOCUMENT) == want
    df = spark.createDataFrame([(old, new)], f"old {DOCUMENT.simpleString()}, new {DOCUMENT.simpleString()}")
    assert df.select(fieldmask.mask(F.col("old"), F.col("new"), DOCUMENT)).first()[0] == want


def test_scalars(spark):
    assert scalars.snake("VehicleSnapshot") == "vehicle_snapshot"
    assert scalars.options_list(" a, ,b,") == ["a", "b"]
    row = spark.range(1).select(scalars.key_or_nil(F.lit(" ")).alias("nil"), scalars.key_or_null(F.lit("")).alias("none"), scalars.to_ms(scalars.to_timestamp(F.lit(1234))).alias("ms"), scalars.meta_set(F.create_map(F.lit("a"), F.lit("1")), "a", F.lit("2")).alias("m")).first()
    assert (row["nil"], row["none"], row["ms"], row["m"]) == (scalars.NIL, None, 1234, {"a": "2"})
    with pytest.raises(Exception, match="not an id"):
        spark.range(1).select(scalars.uuid(F.lit("x"))).collect()
