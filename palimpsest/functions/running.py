"""Running totals and interval islands over long orders.

A window over a whole table runs in one task. These cut the order into range partitions, run
the window partition by partition, and carry totals on through tables of at most one row per
partition, so neither a long table nor a hot key is gathered in one task. The partitions
follow the data, so outliers and clusters of values make none of them large, and there are
as many as the session shuffles into. Nothing is computed before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.numbering import before, ranged


def carried(cut: DataFrame, keys: Sequence[str], aggs: Sequence[Column], carry: Sequence[Column]) -> DataFrame:
    """What partitions hand on, key by key: ``_k0..``, ``_kpart`` and ``carry``, expressions over ``aggs`` in
    the windows :func:`earlier` and :func:`later`.

    Only a key that goes on into another partition has rows, so there are at most two for each partition.
    """
    parts = cut.groupBy(*keys, "_part").agg(*aggs)
    n = F.count(F.lit(1)).over(Window.partitionBy(*(keys or [F.lit(1)])))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return parts.select(*named, F.col("_part").alias("_kpart"), *carry, n.alias("_parts")).filter("_parts > 1").drop("_parts")


def earlier(keys: Sequence[str]):
    """The partitions of a key before this one."""
    return Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` beside what is carried to their key and partition, null where nothing is."""
    on = F.col("_part") == F.col("_kpart")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(carry), on, "left").drop("_kpart", *(f"_k{i}" for i in range(len(keys))))


def running_sum(rows: DataFrame, order: str, value: Column, name: str, keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to and including this one, per ``keys``.

    Rows of equal ``order`` are summed in any order; null values count 0.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    cut = ranged(rows.withColumn("_v", F.coalesce(value, F.lit(0)).cast("long")), [*(F.col(k) for k in keys), by])
    carry = carried(cut, keys, [F.sum("_v").alias("_s")], [F.sum("_s").over(earlier(keys)).alias("_before")])
    inner = Window.partitionBy(*keys, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum("_v").over(inner))
    return with_carry(local, carry, keys).withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def _marked(ranges: DataFrame) -> DataFrame:
    """Ranges ``(start, end)``, those of one start as one, with the greatest end of all before them in ``_upto``."""
    cut = ranged(ranges.groupBy("start").agg(F.max("end").alias("end")), [F.col("start")])
    reach = cut.groupBy("_part").agg(F.max("end").alias("_m")).select("_part", F.max("_m").over(before()).alias("_reach"))
    inner = Window.partitionBy("_part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_local", F.max("end").over(inner)).join(F.broadcast(reach), "_part").withColumn("_upto", F.greatest("_local", "_reach"))


def islands(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """``(start, end)`` of the unions of ranges that touch or overlap, however many in a row.

    Ranges that are null on a side, empty or inverted are left out.
    """
    flat = ranges.select(F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")).filter("start < end")
    first = F.when(F.col("_upto").isNull() | (F.col("start") > F.col("_upto")), F.col("start"))
    so_far = Window.partitionBy("_part").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    # an island that began in an earlier partition has no start of its own here
    pieces = _marked(flat).withColumn("_own", F.max(first).over(so_far)).groupBy("_part", "_own").agg(F.max("end").alias("end"))
    opened = pieces.groupBy("_part").agg(F.max("_own").alias("_f")).select("_part", F.max("_f").over(before()).alias("_open"))
    whole = pieces.join(F.broadcast(opened), "_part").withColumn("start", F.coalesce("_own", "_open"))
    return whole.groupBy("start").agg(F.max("end").alias("end"))


def gaps(ranges: DataFrame, lo: int, hi: int, start: str = "start", end: str = "end") -> DataFrame:
    """``(start, end)`` of what ``ranges`` leave free of ``[lo, hi)``."""
    flat = ranges.select(F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")).filter("start < end")
    inside = flat.filter((F.col("end") > lo) & (F.col("start") < hi))
    edges = ranges.sparkSession.range(2).select(
        F.when(F.col("id") == 0, lo - 1).otherwise(hi).cast("long").alias("start"), F.when(F.col("id") == 0, lo).otherwise(hi + 1).cast("long").alias("end")
    )
    return _marked(inside.unionByName(edges)).filter(F.col("start") > F.col("_upto")).select(F.col("_upto").alias("start"), F.col("start").alias("end"))
