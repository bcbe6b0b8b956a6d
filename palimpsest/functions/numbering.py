"""Consecutive positions over a total order, without gathering the rows in one task.

Rows are range-partitioned once, and what a partition needs to know of those before it is
carried in a table of one row per partition. Both read the same shuffle, so no row is counted
or sorted in advance and nothing is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_PLACE_BITS = 33


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` in range partitions along ``order``, as many as the session shuffles into, with their
    number, which ascends with the order, in ``_part``.

    Equal orders are told apart by a hash of the row, so only exact repeats of a row must stay together.
    A plan may use the result several times and read one shuffle: the condition below is always true,
    but it names every column and is not deterministic, so neither pruning nor filters of one use can
    make its shuffle another one, with other bounds.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        raise RuntimeError("spark.sql.exchange.reuse must be on: positions are told from one shuffle read twice")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digest = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    spread = rows.repartitionByRange(width, *order, digest)
    return spread.filter(F.rand(0) + F.pmod(digest, F.lit(2)) >= 0).withColumn("_part", F.spark_partition_id())


def before() -> WindowSpec:
    """All earlier partitions, over one row for each."""
    return Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_position(rows: DataFrame, order: list[Column], name: str = "pos", first: int = 1) -> DataFrame:
    """``rows`` with a column of consecutive numbers from ``first`` in ``order``.

    Each range partition's rows are counted on from the partitions before it; only one count per
    partition passes through a single task. Ties are numbered in an order of their own.
    """
    cut = ranged(rows, order)
    offsets = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before()), F.lit(0)).alias("_earlier"))
    digest = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    at = F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)
    placed = cut.sortWithinPartitions(*order, digest).withColumn("_id", F.monotonically_increasing_id())
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_earlier") + at + first).select(*rows.columns, name)


def greatest_so_far(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the greatest ``value`` up to and including each row in ``order``; nulls do not count."""
    cut = ranged(rows, order)
    most = cut.groupBy("_part").agg(F.max(value).alias("_m")).select("_part", F.max("_m").over(before()).alias("_earlier"))
    own = F.max(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(F.broadcast(most), "_part").withColumn(name, F.greatest("_own", "_earlier")).select(*rows.columns, name)
