"""The source API: the eight calls as change-log rows and scans."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.scalars import UUID
from foldwright.operators.queue import upsert
from foldwright.sources.schema import CHILD_ROW, PARENT_ROW


def required_id(text: str | None) -> str:
    if not re.match(UUID, (text or "").strip()):
        raise ValueError(f"not an id: {text!r}")
    return text.strip().lower()


@dataclass
class Inventory:
    """Parents and children in memory of the caller, and the log of what happened to them; for fixtures and small tools."""

    parents: dict[str, dict] = field(default_factory=dict)
    children: dict[str, dict] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def _add(self, source: str, op: str, before: dict | None, after: dict | None) -> None:
        self.log.append({"source": source, "op": op, "before": dict(before) if before else None, "after": dict(after) if after else None, "n": len(self.log) + 1})

    def add_parent(self, year: int, model: str, *, key: str | None = None, new_key: str) -> str:
        if key:
            raise ValueError("a new row must not carry an id")
        row = {"VehicleUuid": required_id(new_key), "YearOfManufacture": year, "Model": model}
        self.parents[row["VehicleUuid"]] = row
        self._add("parent", "c", None, row)
        return row["VehicleUuid"]

    def update_parent(self, key: str, year: int, model: str) -> None:
        old = self.parents[required_id(key)]
        self.parents[required_id(key)] = new = {**old, "YearOfManufacture": year, "Model": model}
        self._add("parent", "u", old, new)

    def remove_parent(self, key: str) -> None:
        """Its child is detached first."""
        key = required_id(key)
        for c in [c for c in self.children.values() if c["VehicleUuid"] == key]:
            self.update_child(c["EngineUuid"], {**c, "VehicleUuid": None})
        self._add("parent", "d", self.parents.pop(key), None)

    def add_child(self, row: dict, *, new_key: str) -> str:
        if row.get("EngineUuid"):
            raise ValueError("a new row must not carry an id")
        row = {**row, "EngineUuid": required_id(new_key), "VehicleUuid": (row.get("VehicleUuid") or "").strip().lower() or None}
        if row["VehicleUuid"] and any(c["VehicleUuid"] == row["VehicleUuid"] for c in self.children.values()):
            raise ValueError("the parent has a child")
        self.children[row["EngineUuid"]] = row
        self._add("child", "c", None, row)
        return row["EngineUuid"]

    def update_child(self, key: str, row: dict) -> None:
        old = self.children[required_id(key)]
        self.children[required_id(key)] = new = {**row, "EngineUuid": old["EngineUuid"]}
        self._add("child", "u", old, new)

    def remove_child(self, key: str) -> None:
        self._add("child", "d", self.children.pop(required_id(key)), None)

    def list_parents(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.parents.values()), PARENT_ROW)

    def list_children(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.children.values()), CHILD_ROW)


def list_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """A full scan of some columns."""
    return df.select(*columns)


def find_child(children: DataFrame, foreign_key: str, value: object) -> DataFrame:
    return children.where(F.col(foreign_key) == F.lit(value))


def remove_rows(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys, key, "left_anti")


def update_rows(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows overlaid by new ones of known keys."""
    return upsert(rows, new.join(rows.select(key), key, "left_semi").select(*rows.columns), key)


def removal_cascade(parents: DataFrame, children: DataFrame, key: str, foreign_key: str, child_key: str) -> DataFrame:
    """Log rows for removing parents: for each its child's update to no parent (if it has one), then its removal."""
    detach = children.join(parents.select(F.col(key).alias(foreign_key)), foreign_key, "left_semi").select(F.col(foreign_key).alias("aggregate"), F.lit(1).alias("step"), F.lit("child").alias("source"), F.lit("u").alias("op"), F.col(child_key).cast("string").alias("row_key"))
    gone = parents.select(F.col(key).alias("aggregate"), F.lit(2).alias("step"), F.lit("parent").alias("source"), F.lit("d").alias("op"), F.col(key).cast("string").alias("row_key"))
    return detach.unionByName(gone)
