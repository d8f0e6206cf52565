"""The fold of valid logs in closed form: windows over each aggregate, one shuffle, all in the JVM.

A life begins with the first event of an aggregate and ends with the parent's removal. Within a life each source's latest image
is carried forward, the document is cohesive while both are there, and running counts give the revisions. Logs that may
hold events out of order go through ``by_fold``, the sequential fold of each aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldwright.operators import fold as sequential
from foldwright.sources.schema import CHANGE


def states(log: DataFrame, *, key: str, order: list[str], parent: list[str], child: list[str], mode: str = sequential.INTENDED) -> DataFrame:
    """``log`` (source parent or child; op c, r, u, d, or x: the child is detached) with the state after each event.

    Adds life, each image column as carried, has_parent, has_child, cohesive, revision, published and first.
    """
    whole = Window.partitionBy(key).orderBy(*order)
    gone = (F.col("source") == "parent") & (F.col("op") == "d")
    df = log.withColumn("life", F.coalesce(F.sum(gone.cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    life = Window.partitionBy(key, "life").orderBy(*order)
    upto = life.rowsBetween(Window.unboundedPreceding, 0)

    def carried(source: str, names: list[str]) -> Column:
        here = F.col("source") == source
        image = F.struct(F.col("op").isin("c", "r", "u").alias("there"), *(F.col(n) for n in names))
        return F.last(F.when(here, image), ignorenulls=True).over(upto)

    df = df.withColumn("_p", carried("parent", parent)).withColumn("_c", carried("child", child))
    df = df.withColumn("has_parent", F.coalesce(F.col("_p.there"), F.lit(False))).withColumn("has_child", F.coalesce(F.col("_c.there"), F.lit(False)))
    df = df.select(*(c for c in df.columns if c not in (*parent, *child)), *(F.when(F.col("has_parent"), F.col(f"_p.{n}")).alias(n) for n in parent), *(F.when(F.col("has_child"), F.col(f"_c.{n}")).alias(n) for n in child))
    df = df.withColumn("cohesive", F.col("has_child") & ~gone).withColumn("revision", F.row_number().over(life)).withColumn("first", F.col("revision") == 1)
    df = df.withColumn("published", F.sum(F.col("cohesive").cast("int")).over(upto))
    if mode == sequential.AS_CODED:  # each copy of the state starts counting anew
        df = df.withColumn("revision", F.lit(1)).withColumn("published", F.col("cohesive").cast("int"))
    return df.drop("_p", "_c")


def changes(state: DataFrame, *, key: str, order: list[str], mask: list[tuple[str, str]], mode: str = sequential.INTENDED) -> DataFrame:
    """What is published: cohesive states, and removals of aggregates once published.

    ``mask``: (column, path) pairs in field order; their differences to the state before, joined by commas.
    """
    life = Window.partitionBy(key, "life").orderBy(*order)
    coded = mode == sequential.AS_CODED
    gone = (F.col("source") == "parent") & (F.col("op") == "d")
    ever = F.max("cohesive").over(life.rowsBetween(Window.unboundedPreceding, -1))
    last = F.max("published").over(life.rowsBetween(Window.unboundedPreceding, -1)) if not coded else F.lag("published").over(life)
    # the child's fields all count as changed when it is new, whatever their values
    new_child = F.col("has_child") & ~F.coalesce(F.lag("has_child").over(life), F.lit(False))
    parts = [F.when(~F.col(c).eqNullSafe(F.lag(c).over(life)) | (new_child & F.lit(p.startswith("engine."))), F.lit(p)) for c, p in mask]
    df = state.withColumn("_ever", F.coalesce(ever, F.lit(False))).withColumn("_last", F.coalesce(last, F.lit(0))).withColumn("_mask", F.concat_ws(",", *parts))
    kind = F.when(gone, "VehicleDeleted").when(F.col("first"), "VehicleCreated").otherwise("VehicleUpdated")
    blank = gone | F.col("first") | (F.lit(coded) & (F.col("source") == "child") & (F.col("op") == "u"))
    df = df.where(F.col("cohesive") | (gone & F.col("_ever")))
    return df.withColumn("event_type", kind).withColumn("revision_number", F.when(gone, F.col("_last") + 1).otherwise(F.col("published")).cast("long")).withColumn("field_mask", F.when(blank, "").otherwise(F.col("_mask"))).drop("_ever", "_last", "_mask")


def latest(state: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last state of each aggregate, unless it ended with the parent's removal; partial aggregation, no sort."""
    row = F.max_by(F.struct("source", "op", *columns), F.struct(*order)).alias("s")
    return state.groupBy(key).agg(row).where("NOT (s.source = 'parent' AND s.op = 'd')").select(key, *(F.col(f"s.{c}").alias(c) for c in columns))


def replayed(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The log without repeats of (aggregate, source, sequence)."""
    return log.dropDuplicates([key, "source", *order])


def by_fold(log: DataFrame, mode: str = sequential.INTENDED, states: DataFrame | None = None) -> DataFrame:
    """Rows of schema.CHANGE for a log of schema.LOG: the sequential fold over sorted partitions, one shuffle by aggregate.

    Events stream through; a task holds one aggregate's state and one batch of rows. ``states``: (aggregate, state) to go on
    from. With it the state after the log, as text, comes too: in a row of status ``state``, in the column error.
    """
    names, kind, go_on = CHANGE.names, to_arrow_schema(CHANGE), states is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner, key, out = None, None, []

        def ended() -> None:
            if runner is not None and go_on:
                out.append(dict.fromkeys(names) | {"aggregate": key, "status": "state", "error": sequential.dump(runner.state)})

        for part in batches:
            for row in part.to_pylist():
                if runner is None or row["aggregate"] != key:
                    ended()
                    runner, key = sequential.Runner(mode, sequential.load(row.get("state"))), row["aggregate"]
                out.append(runner.step({**row, "lsn": order_of(row["lsn"])}))
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], type=kind.field(n).type) for n in names], schema=kind)
            out.clear()
        ended()
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], type=kind.field(n).type) for n in names], schema=kind)

    if go_on:
        log = log.join(states.select("aggregate", "state"), "aggregate", "left")
    return log.repartition("aggregate").sortWithinPartitions("aggregate", "lsn", "item").mapInArrow(run, CHANGE)


def order_of(lsn: dict) -> tuple:
    """A pair of sequence numbers as tuples, which compare in order."""
    a, b = lsn["commit"], lsn["change"]
    return (a["vlf"], a["off"], a["slot"]), (b["vlf"], b["off"], b["slot"])


def event(row: dict) -> dict:
    """A log row as the fold takes it."""
    return {**row, "lsn": order_of(plain(row["lsn"])), "before": plain(row["before"]), "after": plain(row["after"])}


def plain(value: object) -> object:
    """Rows as dictionaries, missing numbers as None."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else int(value) if isinstance(value, float) else value

