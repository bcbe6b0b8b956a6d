"""Streams of operations into a store, and running views of a stream."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.store import Store


def ingest(ops: DataFrame, store: Store, checkpoint: str, seconds: int = 5, name: str = "ingest", available_now: bool = False) -> StreamingQuery:
    """Append a stream of operations ``(op, ns, key, ts, value)`` to ``store``, a run per micro-batch.

    A micro-batch that is repeated after a failure is recognised by its number and written once.
    Operations of any lateness are taken: order is by version time.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write_table(batch, batch_id=f"{name}-{number}")

    trigger: dict[str, Any] = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}
    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def once_per_version(log: DataFrame, event_time: str, delay: str) -> DataFrame:
    """A stream of log rows with each version ``(ns, key, ts)`` once within ``delay`` of event time."""
    return log.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["ns", "key", "ts"])


def latest_updates(log: DataFrame) -> DataFrame:
    """A stream, in update mode, of a key's newest version whenever rows of the key arrive: ``(ns, key, ts, seq, value, is_delete)``.

    The state of a key is its newest version, kept by Spark's own aggregation; a late row that is older
    lets the same newest version come out again.
    """
    newest = F.max(F.struct("ts", "seq", "value", "is_delete")).alias("v")
    return log.groupBy("ns", "key").agg(newest).select("ns", "key", "v.ts", "v.seq", "v.value", "v.is_delete")


def write_rates(log: DataFrame, event_time: str, window: str, delay: str) -> DataFrame:
    """Puts and deletes per namespace and window of event time, closed once ``delay`` has passed."""
    rows = log.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "ns")
    return rows.agg(F.count_if(~F.col("is_delete")).alias("puts"), F.count_if("is_delete").alias("deletes")).select("window.start", "window.end", "ns", "puts", "deletes")
