"""Reads of the version log: latest versions, snapshots, histories and range scans.

"Latest" is the largest ``(ts, seq)`` of a key. All of them look at whole logs; per-key
results are partial aggregations, so one key may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.bounds import Bound, between
from palimpsest.functions.numbering import ranged
from palimpsest.functions.running import carried, earlier, with_carry
from palimpsest.model import COLUMNS, IDENTITY, total_order


def latest(log: DataFrame, by: str = "version") -> DataFrame:
    """The newest version of every key, tombstones included, in the log's columns.

    ``by="version"`` takes the largest ``(ts, seq, src)``, ``by="arrival"`` the largest ``seq``.
    """
    order = {"version": ["ts", "seq", "src"], "arrival": ["seq", "ts", "src"]}[by]
    rest = [c for c in COLUMNS if c not in (*IDENTITY, *order)]
    top = F.max(F.struct(*order, *rest)).alias("_top")
    return log.groupBy(*IDENTITY).agg(top).select(*(F.col(c) if c in IDENTITY else F.col(f"_top.{c}").alias(c) for c in COLUMNS))


def live(log: DataFrame, by: str = "version") -> DataFrame:
    """:func:`latest` without keys whose newest version is a tombstone."""
    return latest(log, by).filter(~F.col("is_delete"))


def raw_view(log: DataFrame) -> DataFrame:
    """:func:`latest` with a deleted key's value as empty bytes, as a store without tombstones shows it."""
    return latest(log).withColumn("value", F.when(F.col("is_delete"), F.lit(bytearray(b""))).otherwise(F.col("value")))


def get(log: DataFrame, key: bytes, ns: int = 0) -> DataFrame:
    """The live value of one key: one row or none. Both filters reach the scan."""
    return live(log.filter((F.col("ns") == ns) & (F.col("key") == F.lit(bytearray(key)))))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Live values of the distinct ``(ns, key)`` of ``keys``; a null namespace is 0, missing keys give no row.

    Spark broadcasts ``keys`` where its size is within the session's limit and otherwise joins by
    shuffle; the log's other keys are dropped before the aggregation.
    """
    wanted = keys.select(F.coalesce(F.col("ns"), F.lit(0)).cast("long").alias("ns"), F.col("key").cast("binary").alias("key"))
    return live(log.join(wanted, IDENTITY, "left_semi"))


def as_of(log: DataFrame, ts: int, include_deleted: bool = False) -> DataFrame:
    """The state of every key at version time ``ts``; the filter reaches the scan."""
    past = log.filter(F.col("ts") <= ts)
    return latest(past) if include_deleted else live(past)


def history(log: DataFrame) -> DataFrame:
    """All versions with their number from the newest on, the time to the next older one, and whether
    the value changed: ``version, age_ns, changed`` beside the log's columns.

    The log is range-partitioned in its order, so a key may have any number of versions: a partition
    carries on a key's count, and looks ahead to the first version of the next one.
    """
    newest_first = [F.col("ts").desc(), F.col("seq").desc(), F.col("src").desc()]
    cut = ranged(log.select(*COLUMNS), [*(F.col(c) for c in IDENTITY), *newest_first])
    inner = Window.partitionBy(*IDENTITY, "_part").orderBy(*newest_first)
    carry = carried(
        cut,
        IDENTITY,
        [F.count("*").alias("_n"), F.max(F.struct("ts", "seq", "src", "value")).alias("_top")],
        [F.sum("_n").over(earlier(IDENTITY)).alias("_newer"), F.lead("_top").over(Window.partitionBy(*IDENTITY).orderBy("_part")).alias("_next")],
    )
    local = cut.withColumns({"_i": F.row_number().over(inner), "_lead": F.lead(F.struct("ts", "seq", "src", "value")).over(inner)})
    older = F.coalesce("_lead", "_next")
    return with_carry(local, carry, IDENTITY).select(
        *COLUMNS,
        (F.coalesce("_newer", F.lit(0)) + F.col("_i")).alias("version"),
        (F.col("ts") - older["ts"]).alias("age_ns"),
        (~older["value"].eqNullSafe(F.col("value"))).alias("changed"),
    )


def version_counts(log: DataFrame) -> DataFrame:
    """``(ns, key, versions, tombstones, first_ts, last_ts)`` of every key."""
    return log.groupBy(*IDENTITY).agg(
        F.count("*").alias("versions"),
        F.count_if("is_delete").alias("tombstones"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def scan(log: DataFrame, lo: Bound | None = None, hi: Bound | None = None, ordered: bool = True) -> DataFrame:
    """All versions within the bounds (see :mod:`palimpsest.functions.bounds`), in the log's order."""
    rows = log.filter(between(lo, hi))
    return rows.orderBy(*total_order()) if ordered else rows


def scan_namespace(log: DataFrame, ns: int, ordered: bool = True) -> DataFrame:
    rows = log.filter(F.col("ns") == ns)
    return rows.orderBy(*total_order()) if ordered else rows


def scan_live(log: DataFrame, lo: Bound | None = None, hi: Bound | None = None) -> DataFrame:
    """Live keys whose versions lie within the bounds, in order."""
    return live(log.filter(between(lo, hi))).orderBy("ns", "key")
