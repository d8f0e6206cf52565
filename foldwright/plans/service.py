"""The engine put together: messages in, aggregates kept, changes out, each step a batch that may be repeated."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions import lsn
from foldwright.functions.scalars import event_id
from foldwright.operators import outbox, queue, routing, worker
from foldwright.operators import fold as sequential
from foldwright.plans import batch
from foldwright.plans.scratch import scratch
from foldwright.sources import envelope
from foldwright.sources.schema import CHANGE, CHILD_ROW, ITEM, LOG, OUTBOX_ITEM, PARENT_ROW
from foldwright.sources.store import EventLog, Store

STATES = "aggregate string, state string"
GONE = json.loads(sequential.dump(sequential.State()))


class Aggregator:
    """``parents`` and ``children``: the topics of the two sources.

    State, queue and outbox change in one commit of the store, so an event's effects are all there or none is; events
    and rejects are stored by batch number, and items by ids that depend on the message's place, so a batch that comes again
    changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, sink: Callable[[DataFrame, int], None], *, parents: str, children: str, batch_size: int = 10, scale: int = 12, mode: str = sequential.INTENDED) -> None:
        self.spark, self.root, self.sink, self.mode = spark, root.rstrip("/"), sink, mode
        self.parents, self.children, self.batch_size, self.scale = parents, children, batch_size, scale
        self.events = EventLog(spark, f"{self.root}/log")
        self.store = Store(spark, f"{self.root}/store", {"items": ITEM, "outbox": OUTBOX_ITEM, "states": STATES})

    def _decoded(self, messages: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        return [envelope.decode(messages.where(F.col("topic") == topic), row) for topic, row in ((self.parents, PARENT_ROW), (self.children, CHILD_ROW))]

    def ingest(self, messages: DataFrame, number: int) -> int:
        """Stores a batch of messages, queues their work items, keeps what can't be read aside; the number of new items."""
        self.events.append(messages, number)
        rejects = reduce(DataFrame.unionByName, [bad for _, bad in self._decoded(messages)])
        rejects.write.mode("overwrite").parquet(f"{self.root}/rejects/batch={number}")
        found = []
        for good, _ in self._decoded(messages):
            own = routing.work_items(good, {self.parents: routing.parent_key, self.children: routing.child_key})
            event = event_id(F.col("topic"), F.col("partition"), F.col("offset"))
            found.append(own.select(F.concat_ws("/", event, "position").alias("item"), event.alias("event"), "aggregate", *lsn.flat(F.col("lsn")), F.coalesce("source_ts_ms", "publish_ts_ms", "timestamp_ms").alias("event_ms"), F.lit(None).cast("long").alias("processed_at"), F.lit(0).alias("retry_counter"), F.lit(None).cast("long").alias("next_retry")))
        old = self.store.read("items")
        new = routing.union(*found).join(old.select("item"), "item", "left_anti")
        if n := new.count():
            self.store.commit(items=old.unionByName(new.select(*old.columns)))
        return n

    def _log(self, picked: DataFrame) -> DataFrame:
        """Work items with their events as the fold takes them."""
        key = F.to_json(F.struct(F.struct(F.col("event_key").alias("key")).alias("payload")))
        stored = picked.select("item", "event", "aggregate").join(self.events.events(), "event").select("item", "aggregate", F.col("source").alias("topic"), F.col("source_partition").alias("partition"), F.col("source_offset").alias("offset"), F.col("event_ms").alias("timestamp_ms"), key.alias("key"), F.col("message").alias("value"))
        none = F.lit(None).cast("array<struct<key:string,value:binary>>")
        parts = []
        for (good, _), document, source in zip(self._decoded(stored.withColumn("headers", none)), (envelope.parent_document, envelope.child_document), ("parent", "child"), strict=True):
            rows = good.join(stored.select("topic", "partition", "offset", "item", "aggregate"), ["topic", "partition", "offset"]).dropDuplicates(["item"])
            parts.append(rows.select("aggregate", "item", F.lit(source).alias("source"), "op", "lsn", F.coalesce("source_ts_ms", "publish_ts_ms", "timestamp_ms").alias("ts_ms"), document(F.col("before")).alias("before"), document(F.col("after")).alias("after")))
        return routing.union(*parts).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG.fields))

    def project(self, now_ms: int, blocked: DataFrame | None = None) -> int:
        """Folds the next batch of due items into the aggregates; the number that was processed."""
        items, states = self.store.read("items"), self.store.read("states")
        picked = queue.pick_batch(items, self.batch_size, self.scale, now_ms, blocked)
        if picked.isEmpty():
            return 0
        path = scratch(self.spark, "fold")
        batch.by_fold(self._log(picked), self.mode, states).write.parquet(path)
        rows = self.spark.read.schema(CHANGE).parquet(path)
        new = rows.where("status = 'state'").select("aggregate", F.col("error").alias("state"))
        gone = F.get_json_object("state", "$.document").isNull()
        failed = rows.where("status = 'failed'").select("item", F.lit(True).alias("_bad"))
        flagged = picked.join(failed, "item", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
        done = queue.apply_results(flagged, F.col("_bad"), now_ms).drop("_bad", "status")
        changed = rows.where("event_type IS NOT NULL")
        payload = outbox.change_json(F.col("event_type"), F.col("resulting_state"), F.col("revision_number"), F.col("vehicle_revision_number"), F.col("changed_at_ms"), F.col("aggregate"), F.col("field_mask"))
        sent = outbox.outbox_items(changed, F.col("item"), payload)
        self.store.commit(items=queue.upsert(items, done, "item"), states=queue.upsert(states, new, "aggregate").where(~gone), outbox=queue.upsert(self.store.read("outbox"), sent, "item"))
        return rows.where("status = 'processed'").count()

    def publish(self, now_ms: int, blocked: DataFrame | None = None) -> int:
        return outbox.publish(self.store, self.sink, now_ms, batch=self.batch_size, scale=self.scale, blocked=blocked)

    def purge(self, before_ms: int) -> None:
        """Drops items and outbox items that were done before a time."""
        self.store.commit(items=queue.purge(self.store.read("items"), before_ms), outbox=queue.purge(self.store.read("outbox"), before_ms, queue.OUTBOX))

    def run_sequentially(self, clock: Callable[[], int], stop: threading.Event, listeners: Sequence[worker.Listener] = ()) -> worker.Worker:
        """Projects and publishes until stopped; one writer, so commits don't conflict."""
        loop = worker.Worker("aggregator", lambda: self.project(clock()) + self.publish(clock()), listeners=listeners)
        loop.run(stop)
        return loop
