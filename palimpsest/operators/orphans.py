"""References to parents that are missing, already deleted, or created only later.

Parents are kept as sorted arrays, one row per range of 2^``RANGE_BITS`` ids, so a range
holds at most that many parents. References go to the range of their id in bounded batches
(a range with many references gets many batches), each batch meets its range's array by an
equi-join of compact rows, and one vectorised binary search per batch finds the misses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.times import utc_micros, utc_month

RANGE_BITS = 13
BATCH_ROWS = 20_000
#: Over so many partitions the references of one range spread on their way into batches.
SALTS = 32

_FAR = 2**62


def latest_parents(parents: DataFrame) -> DataFrame:
    """``(id, created_at, deleted_at)`` of the last state of each non-null id: the latest
    ``modified_at`` holds, null being earliest; among equals the latest creation, then the
    latest deletion, a live state (null) before a deleted one."""
    order = F.struct("modified_at", "created_at", (F.col("deleted_at").isNull()).alias("live"), "deleted_at")
    return (
        parents.filter("id IS NOT NULL")
        .groupBy("id")
        .agg(F.max(order).alias("s"))
        .select("id", F.col("s.created_at").alias("created_at"), F.col("s.deleted_at").alias("deleted_at"))
    )


def reference(rows: DataFrame, name: str, key: str, target: str, micros: Column) -> DataFrame:
    """Rows as references ``(ref_table, ref_key, ref_id, at)``, ``at`` in microseconds or null."""
    return rows.filter(F.col(target).isNotNull()).select(
        F.lit(name).alias("ref_table"), F.col(key).cast("long").alias("ref_key"), F.col(target).cast("long").alias("ref_id"), micros.cast("long").alias("at")
    )


def _misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        refs, parents = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            r = refs[k].values
            ids = np.asarray(r.field(2))
            at_null = np.asarray(r.field(3).is_null())
            at = np.asarray(r.field(3).fill_null(0))
            if parents[k].is_valid and len(parents[k].values):
                p = parents[k].values
                have = np.asarray(p.field(0))
                i = np.minimum(np.searchsorted(have, ids), len(have) - 1)
                missing = have[i] != ids
                early = at < np.asarray(p.field(1).fill_null(-_FAR))[i]
                late = at > np.asarray(p.field(2).fill_null(_FAR))[i]
            else:
                missing, early, late = np.ones(len(ids), bool), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            reason = np.where(missing, 1, np.where(at_null, 0, np.where(early, 2, np.where(late, 3, 0))))
            bad = pa.array(np.flatnonzero(reason))
            names = np.array(["", "missing", "created later", "deleted before"], dtype=object)
            yield pa.RecordBatch.from_arrays(
                [r.field(0).take(bad), r.field(1).take(bad), r.field(3).take(bad), pa.array(names[reason[reason > 0]], pa.string())],
                names=["ref_table", "ref_key", "at", "reason"],
            )


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """``(ref_table, ref_key, period, reason)``: each orphan among ``refs`` (see :func:`reference`).

    ``parents`` has ``id, modified_at, created_at, deleted_at``, times in seconds. An orphan's id
    is missing, or its time lies before the creation or after the deletion; equal times are no
    orphan, a null creation or deletion bounds nothing, and with a null time only the missing id
    counts. ``period`` is the month in UTC, 'unknown' without a time. Repeated references are
    reported each; without parents every reference is an orphan; other columns are not read.
    """
    span = lambda c: F.shiftright(F.col(c), RANGE_BITS)
    micros = lambda c: F.col(c) * 1_000_000
    arrays = (
        latest_parents(parents)
        .select(span("id").alias("range"), F.struct("id", micros("created_at").alias("created"), micros("deleted_at").alias("deleted")).alias("p"))
        .groupBy("range")
        .agg(F.sort_array(F.collect_list("p")).alias("parents"))
    )
    # every row has a salt of its own, so neither a hot range nor exact repeats of a reference meet in one place
    refs = refs.withColumn("range", span("ref_id")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    refs = refs.withColumn("way", F.pmod("salt", F.lit(SALTS)))
    width = refs.groupBy("range").agg(F.ceil(F.count("*") / BATCH_ROWS).alias("batches"))
    width = width.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    batched = (
        refs.join(width, ["range", "way"])
        .withColumn("batch", F.pmod(F.shiftright("salt", 8), F.col("batches")))
        .groupBy("range", "batch")
        .agg(F.collect_list(F.struct("ref_table", "ref_key", "ref_id", "at")).alias("refs"))
    )
    found = batched.join(arrays, "range", "left").select("refs", "parents").mapInArrow(
        _misses, "ref_table string, ref_key long, at long, reason string"
    )
    return found.select("ref_table", "ref_key", F.coalesce(utc_month("at"), F.lit("unknown")).alias("period"), "reason")


def store_references(journal: DataFrame, open_extents: DataFrame, segment_index: DataFrame) -> DataFrame:
    """The references of the three metadata tables to extents."""
    seconds = F.col("entry_time") * 1_000_000
    return (
        reference(journal.filter(F.col("entry_type").isin(1, 2, 3)), "journal", "seq", "frange_id", seconds)
        .unionByName(reference(open_extents, "open_extents", "handle_id", "id", utc_micros(open_extents, "opened_at")))
        .unionByName(reference(segment_index, "segment_index", "row_id", "id", utc_micros(segment_index, "written_at")))
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Misses per table, period and reason: ``(ref_table, period, reason, orphans)``."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("orphans"))
