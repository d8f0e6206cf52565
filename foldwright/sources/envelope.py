"""Change envelopes: decoding, validation and the reject branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions import lsn
from foldwright.functions.scalars import NIL, is_uuid, uuid

OPS = ("c", "r", "u", "d")


def json_text(value: Column) -> Column:
    """Null and blank values are the empty object."""
    return F.coalesce(F.when(F.trim(value) != "", value), F.lit("{}"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row: no filter or projection above a generator takes their text in."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def fields(value: Column) -> Column:
    """The fields of a variant that is an object, else null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def payload(parsed: Column) -> Column:
    """The top-level ``payload``, whatever the case of its name; null if there is none."""
    return F.get(F.filter(F.map_entries(fields(parsed)), lambda e: F.lower(e["key"]) == "payload"), F.lit(0))["value"]


def present(value: Column) -> Column:
    """A container with children; anything else is absent."""
    size = F.coalesce(F.size(fields(value)), F.size(F.try_variant_get(value, "$", "array<variant>")))
    return value.isNotNull() & F.coalesce(size > 0, F.lit(False))


def key_of(parsed: Column) -> Column:
    """The id in a message key ``{"payload": {name: id}}``; without exactly one field the nil id; a malformed id is null."""
    own = F.coalesce(F.map_values(fields(payload(parsed))), F.array().cast("array<variant>"))
    one = F.try_variant_get(F.get(own, F.lit(0)), "$", "string")
    return F.when(F.size(own) != 1, F.lit(NIL)).when(is_uuid(one), F.lower(F.trim(one)))


def image(value: Column, row: T.StructType) -> Column:
    """A row image as ``row``; what doesn't fit a field's type is null there."""
    return F.struct(*(F.try_variant_get(value, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in row))


def headers_map(headers: Column, partition: Column) -> Column:
    """Headers as a map, with the partition; null headers give an empty map (and so no partition)."""
    own = F.create_map(F.lit("Partition"), partition.cast("string").cast("binary"))
    return F.when(headers.isNull(), F.create_map().cast("map<string,binary>")).otherwise(F.map_concat(F.map_from_entries(headers), own))


def decode(messages: DataFrame, row: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of change messages with the columns of schema.MESSAGE.

    Good rows: topic, offset, key_id, tombstone, op, lsn pair, ts_ms, before and after as ``row``. Rejects keep the
    message and have ``error``. Nothing is dropped: each message is in one of the two. Value and key are each parsed once.
    """
    get = lambda p, kind="string": F.try_variant_get("_payload", p, kind)
    df = once(messages, _value=F.try_parse_json(json_text(F.col("value"))), _key=F.try_parse_json(json_text(F.col("key"))))
    df = once(df, _payload=payload(F.col("_value")), key_id=key_of(F.col("_key")))
    df = once(df, op=F.lower(get("$.op")), _before=get("$.before", "variant"), _after=get("$.after", "variant"), change_lsn=F.lower(get("$.source.change_lsn")), commit_lsn=F.lower(get("$.source.commit_lsn")), source_ts_ms=get("$.source.ts_ms", "long"), publish_ts_ms=get("$.ts_ms", "long"), tombstone=F.col("_value").isNotNull() & ~present(F.col("_payload")))
    df = once(df, _has_before=present(F.col("_before")), _has_after=present(F.col("_after")))
    df = once(df, error=_error())
    pair = lsn.pair(F.col("commit_lsn"), F.col("change_lsn"))
    good = df.where("error IS NULL").select(
        "topic", "partition", "offset", "timestamp_ms", "key_id", "tombstone", "op", F.when(~F.col("tombstone"), pair).alias("lsn"), "source_ts_ms", "publish_ts_ms",
        F.when(F.col("_has_before"), image(F.col("_before"), row)).alias("before"), F.when(F.col("_has_after"), image(F.col("_after"), row)).alias("after"), headers_map(F.col("headers"), F.col("partition")).alias("headers"),
    )
    return good, df.where("error IS NOT NULL").select(*messages.columns, "error")


def _error() -> Column:
    """The first rule that a message breaks; tombstones break none."""
    before, after, op = F.col("_has_before"), F.col("_has_after"), F.col("op")
    bad_shape = F.when(op.isin("c", "r"), ~after | before).when(op == "u", ~after | ~before).when(op == "d", ~before | after)
    return (
        F.when(F.col("key").isNull(), "no key")
        .when(F.col("_value").isNull(), "malformed json")
        .when(F.col("key_id").isNull(), "malformed key")
        .when(F.col("tombstone"), F.lit(None).cast("string"))
        .when(op.isNull() | ~op.isin(*OPS), "unknown operation")
        .when(bad_shape, "wrong images for the operation")
        .when(~lsn.is_valid(F.col("commit_lsn")), "bad commit number")
        .when(lsn.blank_to_null(F.col("change_lsn")).isNotNull() & ~lsn.is_valid(F.col("change_lsn")), "bad change number")
    )


def parent_document(row: Column) -> Column:
    """A parent row as the document; the id in canonical form."""
    return F.when(row.isNotNull(), F.struct(uuid(row["VehicleUuid"]).alias("vehicle_uuid"), row["YearOfManufacture"].alias("year_of_manufacture"), row["Model"].alias("model"), F.lit(None).cast("struct<engine_uuid:string,vehicle_uuid:string,year_of_manufacture:int,manufacturer:string,maximum_engine_speed:int,maximum_mileage_resource:int,remaining_mileage_resource:int>").alias("engine")))


def child_document(row: Column) -> Column:
    child = F.struct(uuid(row["EngineUuid"]).alias("engine_uuid"), uuid(row["VehicleUuid"]).alias("vehicle_uuid"), row["YearOfManufacture"].alias("year_of_manufacture"), row["Manufacturer"].alias("manufacturer"), row["MaximumEngineSpeed"].alias("maximum_engine_speed"), row["MaximumMileageResource"].alias("maximum_mileage_resource"), row["RemainingMileageResource"].alias("remaining_mileage_resource"))
    return F.when(row.isNotNull(), F.struct(uuid(row["VehicleUuid"]).alias("vehicle_uuid"), F.lit(None).cast("int").alias("year_of_manufacture"), F.lit(None).cast("string").alias("model"), child.alias("engine")))
