"""Sources and sinks: one reader and one writer factory; JSON and Parquet work offline, Kafka and JDBC need their jars."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.scalars import options_list, snake


@dataclass(frozen=True)
class KafkaSource:
    """Options of a topic source; ``topics`` is a comma-separated list."""

    servers: str
    topics: str
    group: str = "aggregator"
    protocol: str | None = None
    sasl: Mapping[str, str] = field(default_factory=dict)
    max_poll_ms: int = 300_000

    def options(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": self.servers, "subscribe": ",".join(options_list(self.topics)), "startingOffsets": "earliest", "includeHeaders": "true", "kafka.group.id": self.group, "kafka.max.poll.interval.ms": str(self.max_poll_ms)}
        return out | ({"kafka.security.protocol": self.protocol} if self.protocol else {}) | {f"kafka.sasl.{k}": v for k, v in self.sasl.items()}


@dataclass(frozen=True)
class KafkaSink:
    servers: str
    topic: str = "Vehicles"
    retries: int = 10
    backoff_ms: int = 100

    def options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic, "kafka.max.in.flight.requests.per.connection": "1", "kafka.retries": str(self.retries), "kafka.retry.backoff.ms": str(self.backoff_ms)}


def options_from_env(env: Mapping[str, str], section: str, kind: type) -> object:
    """A dataclass from variables named ``SECTION_FIELD``; fields without one keep their defaults."""
    prefix = f"{snake(section).upper()}_"
    kinds = {"int": int, "bool": lambda x: x.lower() == "true"}
    found = {k[len(prefix) :].lower(): v for k, v in env.items() if k.upper().startswith(prefix)}
    return kind(**{name: kinds.get(str(f.type), str)(found[name]) for name, f in kind.__dataclass_fields__.items() if name in found})


def read(spark: SparkSession, kind: str, path: str = "", schema: T.StructType | str | None = None, *, stream: bool = False, **options: str) -> DataFrame:
    """Batch or streaming reader by kind: parquet, json, kafka, jdbc."""
    reader = (spark.readStream if stream else spark.read).format(kind).options(**options)
    if schema is not None and kind not in ("kafka", "jdbc"):
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def kafka_messages(raw: DataFrame) -> DataFrame:
    """Kafka's columns as schema.MESSAGE."""
    return raw.select("topic", "partition", "offset", F.unix_millis("timestamp").alias("timestamp_ms"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "headers")


def find(df: DataFrame, column: str, value: object) -> DataFrame:
    """Point lookup; the predicate reaches the scan."""
    return df.where(F.col(column) == F.lit(value))


def many(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    return spark.sql(sql, args=args)


def single_or_none(df: DataFrame) -> Row | None:
    """The only row, or None; two rows raise."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None


def single(df: DataFrame) -> Row:
    if (row := single_or_none(df)) is None:
        raise ValueError("no row")
    return row


def scalar(df: DataFrame) -> object:
    return single(df)[0]


def overwrite_atomically(df: DataFrame, path: str) -> None:
    """Writes a new table beside ``path`` and swaps it in; readers see the old or the new table, never half of one.

    File systems can't replace a folder in one step, so between two renames there is no table for a moment; ``store.Store``
    has no such gap.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = lambda *x: jvm.org.apache.hadoop.fs.Path(*x)
    here = to(path)
    new, old = (to(here.getParent(), f".{here.getName()}.{x}") for x in ("new", "old"))
    df.write.mode("overwrite").parquet(new.toString())
    fs = here.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def to_kafka_rows(messages: DataFrame) -> DataFrame:
    """topic, key and JSON value for a topic sink."""
    rest: list[Column] = [F.col(c) for c in messages.columns if c not in ("topic", "key")]
    return messages.select("topic", "key", F.to_json(F.struct(*rest)).alias("value"))
