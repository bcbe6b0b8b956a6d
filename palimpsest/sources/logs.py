"""Adapters from stored tables to the version log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.times import utc_micros
from palimpsest.model import conform


def nanos(rows: DataFrame, column: str) -> Column:
    """Nanoseconds since the epoch of a timestamp column, zone-less ones in UTC."""
    return utc_micros(rows, column) * 1000


# Namespaces of the event types; one lies above a byte's range.
EVENT_NAMESPACES = {"click": 1, "view": 2, "purchase": 255, "signup": 256, "error": 300}


def from_events(events: DataFrame) -> DataFrame:
    """A log of users' events: a namespace per type, the user as key, an error as tombstone."""
    kind = F.col("event_type")
    ns = F.lit(0)
    for name, n in EVENT_NAMESPACES.items():
        ns = F.when(kind == name, n).otherwise(ns)
    return conform(
        events.select(
            ns.alias("ns"), F.col("user_id").cast("string").cast("binary").alias("key"), nanos(events, "ts").alias("ts"), kind.cast("binary").alias("value"),
            F.coalesce(kind == "error", F.lit(False)).alias("is_delete"), F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(8)).alias("src"),
        )
    )


def from_orders(orders: DataFrame) -> DataFrame:
    """A log of customers' order states; several orders of a day share a version time."""
    return conform(
        orders.select(
            F.lit(0).alias("ns"), F.col("o_custkey").cast("string").cast("binary").alias("key"), nanos(orders, "o_orderdate").alias("ts"),
            F.col("o_orderstatus").cast("binary").alias("value"), F.lit(False).alias("is_delete"), F.col("o_orderkey").alias("seq"), F.pmod("o_orderkey", F.lit(4)).alias("src"),
        )
    )


def from_version_log(log: DataFrame) -> DataFrame:
    """The stored log as it is, of rows the model allows: pointer rows and null keys are not read.

    A null namespace is 0; version times below 10^17 are microseconds and become nanoseconds.
    """
    ts = F.when(F.col("ts") < 10**17, F.col("ts") * 1000).otherwise(F.col("ts"))
    return conform(log.select("ns", "key", ts.alias("ts"), F.col("val").alias("value"), "is_delete", "seq", "src").withColumn("ns", F.coalesce("ns", F.lit(0))))
