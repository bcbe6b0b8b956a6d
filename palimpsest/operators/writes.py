"""Writes as tables of operations: normalising batches, exact versions, sizes, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import CapacityExceeded
from palimpsest.functions.codecs import run_bytes
from palimpsest.functions.numbering import with_position
from palimpsest.functions.running import running_sum
from palimpsest.model import COLUMNS, VERSION, conform

# The kinds of operations; those without a namespace go to namespace 0.
PUT, DELETE, PUT_NS, DELETE_NS = "put", "delete", "put_ns", "delete_ns"


def op_name(op: Column) -> Column:
    """An operation's name whatever its case and surrounding blanks."""
    return F.lower(F.trim(op))


def normalise_batch(ops: DataFrame, seq: str = "seq", value: str = "value", src: int = 0) -> DataFrame:
    """Operations ``(op, ns, key, ts, value)`` as log rows, in the order of ``seq``.

    Un-namespaced operations and null namespaces go to namespace 0, deletes carry no value. Rows of
    an unknown or null operation, a null key, or a version time that is null or not above 0 are left
    out; :func:`rejected_operations` gives them. A put of a null value is a put of null.
    """
    op = op_name(F.col("op"))
    rows = ops.select(
        F.when(op.isin(PUT, DELETE), F.lit(0)).otherwise(F.coalesce(F.col("ns"), F.lit(0))).alias("ns"),
        "key",
        "ts",
        F.col(value).alias("value"),
        op.isin(DELETE, DELETE_NS).alias("is_delete"),
        F.col(seq).alias("seq"),
        F.lit(src).alias("src"),
        op.isin(PUT, DELETE, PUT_NS, DELETE_NS).alias("_known"),
    )
    return conform(rows.filter("_known"))


def rejected_operations(ops: DataFrame, seq: str = "seq") -> DataFrame:
    """``(seq, reason)`` of operations that :func:`normalise_batch` leaves out."""
    op = op_name(F.col("op"))
    ns = F.when(op.isin(PUT_NS, DELETE_NS), F.col("ns"))
    reason = (
        F.when(~F.coalesce(op.isin(PUT, DELETE, PUT_NS, DELETE_NS), F.lit(False)), "operation")
        .when(F.col("key").isNull(), "key")
        .when(F.coalesce(F.col("ts"), F.lit(0)) <= 0, "version time")
        .when(ns < 0, "namespace")
    )
    return ops.select(F.col(seq).alias("seq"), reason.alias("reason")).filter("reason IS NOT NULL")


def put(rows: DataFrame) -> DataFrame:
    """``rows`` as puts; without ``ns`` they go to namespace 0."""
    return conform(rows.withColumn("is_delete", F.lit(False)))


def delete(rows: DataFrame) -> DataFrame:
    """``rows`` as tombstones; without ``ns`` they go to namespace 0."""
    return conform(rows.withColumn("is_delete", F.lit(True)))


def exact_versions(log: DataFrame, per_run: bool = True) -> DataFrame:
    """One row per version ``(ns, key, ts)``, the latest arrival, within each run or over all of them."""
    keys = [*VERSION, "src"] if per_run else VERSION
    rest = [c for c in COLUMNS if c not in keys and c != "seq"]
    top = F.max(F.struct("seq", *rest)).alias("_top")
    return log.groupBy(*keys).agg(top).select(*(F.col(c) if c in keys else F.col(f"_top.{c}").alias(c) for c in COLUMNS))


def run_sizes(log: DataFrame) -> DataFrame:
    """``(src, rows, bytes)`` of every run as its limit counts them: every write of a version counts."""
    return log.groupBy("src").agg(F.count("*").alias("rows"), F.sum(run_bytes(F.col("key"), F.col("value"))).alias("bytes"))


def admission(log: DataFrame, limit: int, used: int = 0) -> DataFrame:
    """Per run, the rows in order of arrival with their running size and whether the run takes them:
    the log's columns, ``running_bytes`` and ``admitted``.

    The first row that would exceed ``limit`` and all after it are refused.
    """
    running = running_sum(log, "seq", run_bytes(F.col("key"), F.col("value")), "running_bytes", keys=["src"])
    running = running.withColumn("running_bytes", F.col("running_bytes") + used)
    return running.select(*COLUMNS, "running_bytes", (F.col("running_bytes") <= limit).alias("admitted"))


def admit(log: DataFrame, limit: int, used: int = 0, partial: bool = False) -> DataFrame:
    """The rows a run takes. A batch is taken whole or raises :class:`CapacityExceeded`; with
    ``partial`` the rows before the first that does not fit are taken."""
    if partial:
        return admission(log, limit, used).filter("admitted").select(*COLUMNS)
    total = log.agg(F.coalesce(F.sum(run_bytes(F.col("key"), F.col("value"))), F.lit(0))).first()[0]
    if total + used > limit:
        raise CapacityExceeded(f"{total + used} bytes in a run of {limit}")
    return log


def stamped(rows: DataFrame, base: int, order: str = "seq") -> DataFrame:
    """``rows`` with version times from ``base`` on, one each, in ``order``."""
    return with_position(rows.drop("ts"), [F.col(order)], "ts", first=base)
