"""Routing: which aggregates an event concerns, and its work items."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From an image of a row to the key of its aggregate, or null.
KeyExtractor = Callable[[Column], Column]


def child_key(row: Column) -> Column:
    return F.lower(row["VehicleUuid"])


def parent_key(row: Column) -> Column:
    return F.lower(row["VehicleUuid"])


def affected(op: Column, before_key: Column, after_key: Column) -> Column:
    """Keys of the aggregates that an event concerns: none, one, or two with the one before first."""
    both = F.when(op == "u", F.array(before_key, after_key)).when(op == "d", F.array(before_key)).otherwise(F.array(after_key))
    return F.array_distinct(F.array_compact(both))


def fan_out(events: DataFrame, op: Column, before_key: Column, after_key: Column, out: str = "aggregate") -> DataFrame:
    """One row for each aggregate of each event, with its position; tombstones (null op) and keyless events give none."""
    keys = F.when(op.isNotNull(), affected(op, before_key, after_key))
    return events.select("*", F.posexplode(keys).alias("position", out))


def work_items(good: DataFrame, extractors: Mapping[str, KeyExtractor]) -> DataFrame:
    """Work items of decoded events (one source's, or a union), by the key extractor of each topic."""
    before = after = F.lit(None).cast("string")
    for topic, key in extractors.items():
        here = F.col("topic") == topic
        before, after = F.when(here, key(F.col("before"))).otherwise(before), F.when(here, key(F.col("after"))).otherwise(after)
    return fan_out(good.where(~F.col("tombstone")), F.col("op"), before, after)


def union(*sources: DataFrame) -> DataFrame:
    """Several sources' events or items in one queue."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def route(handlers: Mapping[str, Callable[[DataFrame], DataFrame]], events: DataFrame, by: str = "topic") -> DataFrame:
    """Each source's events through its handler; events of unknown sources raise."""
    known = events.withColumn(by, F.when(F.col(by).isin(*handlers), F.col(by)).otherwise(F.raise_error(F.concat(F.lit("no handler for "), F.coalesce(F.col(by), F.lit("null"))))))
    return union(*(h(known.where(F.col(by) == name)) for name, h in handlers.items()))
