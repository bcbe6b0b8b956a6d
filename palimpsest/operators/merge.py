"""Merging sorted runs, and compaction to the newest versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.bounds import Bound, between
from palimpsest.functions.numbering import with_position
from palimpsest.model import COLUMNS, IDENTITY, empty_log, total_order
from palimpsest.operators.reads import latest


def runs(parts: Sequence[DataFrame], spark=None) -> DataFrame:
    """Runs as one log, each tagged with its place in ``parts`` as ``src``; no runs give an empty log."""
    if not parts:
        return empty_log(spark)
    return reduce(DataFrame.unionByName, (p.select(*COLUMNS).withColumn("src", F.lit(i)) for i, p in enumerate(parts)))


def merge(log: DataFrame, lo: Bound | None = None, hi: Bound | None = None) -> DataFrame:
    """All versions of all runs within the bounds, in the log's order; nothing is deduplicated.

    Pointer rows (version time 0) are no versions. Of equal versions the latest run comes first,
    then the latest arrival. The sort is range-partitioned and spills.
    """
    return log.filter((F.col("ts") > 0) & between(lo, hi)).orderBy(*total_order())


def merge_positions(log: DataFrame, lo: Bound | None = None, hi: Bound | None = None) -> DataFrame:
    """:func:`merge` with the place of every version in ``pos``, from 1."""
    return with_position(log.filter((F.col("ts") > 0) & between(lo, hi)), total_order(), "pos")


def first_of_merge(log: DataFrame, lo: Bound | None = None, hi: Bound | None = None, n: int = 1) -> DataFrame:
    """The first ``n`` versions of a merge; each task keeps ``n`` rows only."""
    return log.filter((F.col("ts") > 0) & between(lo, hi)).orderBy(*total_order()).limit(n)


def first_per_probe(log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each distinct ``(ns, key)`` of ``probes`` the first version of the merge from its newest on:
    its latest version, tombstone or not."""
    wanted = probes.select(F.col("ns").cast("long").alias("ns"), F.col("key").cast("binary").alias("key"))
    return latest(log.filter("ts > 0").join(wanted, IDENTITY, "left_semi"))


def compact(log: DataFrame, drop_tombstones: bool = False, src: int = 0) -> DataFrame:
    """One run of the newest version of every key.

    Tombstones stay unless ``drop_tombstones``, which is right only if ``log`` holds all runs: else
    older runs would bring a deleted key back.
    """
    rows = latest(log.filter("ts > 0")).withColumn("src", F.lit(src))
    return rows.filter("NOT is_delete") if drop_tombstones else rows


def sorted_run(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """``log`` laid out for a run's files: range-partitioned and sorted, so that file and row-group
    statistics bound every scan."""
    by = [F.col("ns"), F.col("key")]
    spread = log.repartitionByRange(partitions, *by) if partitions else log.repartitionByRange(*by)
    return spread.sortWithinPartitions(*total_order())


def run_stats(log: DataFrame) -> DataFrame:
    """``(src, rows, keys, tombstones, namespaces, min_ts, max_ts)`` of every run.

    Distinct keys are counted over rows that are reduced to one per run and key first.
    """
    per_key = log.groupBy("src", *IDENTITY).agg(
        F.count("*").alias("n"), F.count_if("is_delete").alias("d"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    per_ns = per_key.groupBy("src", "ns").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return per_ns.groupBy("src").agg(
        F.sum("n").alias("rows"), F.sum("k").alias("keys"), F.sum("d").alias("tombstones"), F.count("*").alias("namespaces"),
        F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"),
    )


def overlap(log: DataFrame) -> DataFrame:
    """``(runs, keys)``: how many keys stand in how many runs."""
    return log.groupBy(*IDENTITY).agg(F.count_distinct("src").alias("runs")).groupBy("runs").agg(F.count("*").alias("keys"))
