"""The extent store's space as tables: allocation, coalescing, statistics, compaction choices.

``extents`` are rows ``(id, range_start, range_end, length, size, created_at, modified_at)``,
free ranges rows ``(start, end)``; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codecs import le_hex, le_numbers
from palimpsest.functions.running import gaps, islands

# The page size and the sizes of the store's own regions and records.
PAGE_BYTES = 4096
HEADER_BYTES = 56
METADATA_BYTES = 4096
JOURNAL_BYTES = 1 << 20
EXTENT_RECORD_BYTES = 64
RANGE_RECORD_BYTES = 16
COUNT_BYTES = 8
# When compaction is due and what it takes.
FRAGMENTATION_THRESHOLD = 0.3
MIN_FRAGMENT_BYTES = 4096
MAX_COMPACT_BATCH = 10


def current_extents(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each non-null id (see :func:`palimpsest.operators.orphans.latest_parents`),
    without ids whose last snapshot is deleted. ``length`` null counts 0."""
    order = F.struct(
        "modified_at", "created_at", F.col("deleted_at").isNull().alias("live"), "deleted_at", "range_start", "range_end", "length", "size"
    )
    rows = snapshots.filter("id IS NOT NULL").groupBy("id").agg(F.max(order).alias("s")).filter("s.deleted_at IS NULL")
    names = ["range_start", "range_end", "length", "size", "created_at", "modified_at"]
    return rows.select("id", *(F.col(f"s.{n}").alias(n) for n in names)).withColumn("length", F.coalesce("length", F.lit(0)))


def free_ranges(extents: DataFrame, lo: int, hi: int) -> DataFrame:
    """What the extents leave free of ``[lo, hi)``, fully coalesced."""
    return gaps(extents, lo, hi, "range_start", "range_end")


def coalesce_ranges(free: DataFrame) -> DataFrame:
    """Free ranges that touch or overlap, merged transitively."""
    return islands(free, "start", "end")


def total_free(free: DataFrame) -> DataFrame:
    """One row ``(free_bytes)``; 0 without ranges."""
    return free.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("free_bytes"))


def total_used(extents: DataFrame) -> DataFrame:
    """One row ``(used_bytes)``; 0 without extents."""
    return extents.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("used_bytes"))


def _with_space(requests: DataFrame, free: DataFrame) -> DataFrame:
    one = free.agg(
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("_free"), F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(0)).alias("_largest")
    ).withColumn("_one", F.lit(1))
    return requests.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def can_allocate(requests: DataFrame, free: DataFrame) -> DataFrame:
    """``requests`` ``(size, ...)`` with ``fits``: whether some free range is large enough."""
    return _with_space(requests, free).withColumn("fits", F.col("_largest") >= F.col("size")).drop("_free", "_largest")


def classify_allocation(requests: DataFrame, free: DataFrame) -> DataFrame:
    """``requests`` with ``outcome`` of each if it came alone: 'ok', 'storage exhausted' if all free space
    is too little, 'fragmentation limit' if no single range is large enough; null for a null size."""
    outcome = (
        F.when(F.col("size").isNull(), None)
        .when(F.col("_largest") >= F.col("size"), "ok")
        .when(F.col("size") > F.col("_free"), "storage exhausted")
        .otherwise("fragmentation limit")
    )
    return _with_space(requests, free).withColumn("outcome", outcome).drop("_free", "_largest")


def rightmost_fit(free: DataFrame, size: int, data_start: int = 0) -> DataFrame:
    """The range an allocation of ``size`` takes, as one row or none: ``(start, end, free_start, free_end)``.

    The free range of the highest start that is large enough and lies in the data region is used from
    its right end; ``free_start, free_end`` is that range, of which the left part stays free.
    """
    return (
        free.filter((F.col("end") - F.col("start") >= size) & (F.col("start") >= data_start))
        .orderBy(F.col("start").desc(), F.col("end").desc())
        .limit(1)
        .select((F.col("end") - size).alias("start"), "end", F.col("start").alias("free_start"), F.col("end").alias("free_end"))
    )


def after_allocation(free: DataFrame, taken: DataFrame) -> DataFrame:
    """Free ranges after the allocation that :func:`rightmost_fit` gave as ``taken``."""
    used = taken.select(F.col("free_start").alias("start"), F.col("free_end").alias("end"))
    left = taken.select(F.col("free_start").alias("start"), F.col("start").alias("end")).filter("start < end")
    return free.select("start", "end").join(used, ["start", "end"], "left_anti").unionByName(left)


def delete_extents(extents: DataFrame, free: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extents and free ranges after the deletion of ``ids``; missing ids change nothing."""
    ids = ids.select("id").distinct()
    back = extents.join(ids, "id", "left_semi").select(F.col("range_start").alias("start"), F.col("range_end").alias("end"))
    return extents.join(ids, "id", "left_anti"), coalesce_ranges(free.select("start", "end").unionByName(back))


def fragmentation(free: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row: total, number, largest, whole-number average and number below a page of free ranges; all 0
    without any."""
    n = F.col("end") - F.col("start")
    zero = F.lit(0)
    return free.select(n.alias("n")).agg(
        F.coalesce(F.sum("n"), zero).cast("long").alias("total_free_space"),
        F.count("n").alias("free_range_count"),
        F.coalesce(F.max("n"), zero).cast("long").alias("largest_free_block"),
        F.coalesce(F.expr("sum(n) div count(n)"), zero).cast("long").alias("average_fragment_size"),
        F.count_if(F.col("n") < page_bytes).alias("small_fragments"),
    )


def _space(free: DataFrame, extents: DataFrame) -> DataFrame:
    one = F.lit(1).alias("_one")
    return fragmentation(free).select("*", one).join(total_used(extents).select("*", one), "_one").drop("_one")


def compaction_trigger(free: DataFrame, extents: DataFrame, threshold: float = FRAGMENTATION_THRESHOLD) -> DataFrame:
    """One row ``(ratio, due)``: range count times average size over all space, and whether it reaches
    ``threshold``; without any space the ratio is 0 and nothing is due."""
    ratio = F.try_divide(F.col("free_range_count") * F.col("average_fragment_size"), F.col("total_free_space") + F.col("used_bytes"))
    return _space(free, extents).select(F.coalesce(ratio, F.lit(0.0)).alias("ratio")).withColumn("due", F.col("ratio") >= threshold)


def compaction_candidates(
    extents: DataFrame, open_ids: DataFrame, min_fragment: int = MIN_FRAGMENT_BYTES, batch: int | None = MAX_COMPACT_BATCH
) -> DataFrame:
    """Closed extents whose unused part is at least ``min_fragment``, the first ``batch`` by id (all if None):
    the extents' columns and ``unused``."""
    unused = F.col("range_end") - F.col("range_start") - F.coalesce(F.col("length"), F.lit(0))
    closed = extents.join(open_ids.select("id").distinct(), "id", "left_anti")
    found = closed.withColumn("unused", unused).filter(F.col("unused") >= min_fragment)
    return found if batch is None else found.orderBy("id").limit(batch)


def dirty_pages(writes: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Distinct pages that writes ``(start, end)`` touch; empty writes touch none."""
    spans = writes.filter("start < end").select(
        F.explode(F.sequence(F.expr(f"start div {page_bytes}"), F.expr(f"(end - 1) div {page_bytes}"))).alias("page")
    )
    return spans.distinct()


def consolidate_pages(pages: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Byte ranges ``(start, end)`` of pages in a row."""
    at = F.col("page") * page_bytes
    return islands(pages.filter("page IS NOT NULL").select(at.alias("start"), (at + page_bytes).alias("end")), "start", "end")


def write_ranges(writes: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """What a flush writes for ``writes`` ``(start, end)``: :func:`consolidate_pages` of
    :func:`dirty_pages`, without a row for each page."""
    pages = writes.filter("start < end").select(
        F.expr(f"start div {page_bytes} * {page_bytes}").alias("start"), F.expr(f"((end - 1) div {page_bytes} + 1) * {page_bytes}").alias("end")
    )
    return islands(pages, "start", "end")


def health(free: DataFrame, extents: DataFrame, capacity: int, metadata_bytes: int = METADATA_BYTES) -> DataFrame:
    """One row on the store: whether free and used space make up ``capacity``, whether the metadata fit
    their region, fragmentation in percent, and the sizes themselves."""
    one = F.lit(1).alias("_one")
    allocated = extents.agg(
        F.coalesce(F.sum(F.col("range_end") - F.col("range_start")), F.lit(0)).cast("long").alias("allocated"), F.count("*").alias("extents")
    )
    rows = _space(free, extents).select("*", one).join(allocated.select("*", one), "_one").drop("_one")
    need = COUNT_BYTES + EXTENT_RECORD_BYTES * F.col("extents") + COUNT_BYTES + RANGE_RECORD_BYTES * F.col("free_range_count")
    share = F.when(F.col("total_free_space") > 0, 100 * (1 - F.col("largest_free_block") / F.col("total_free_space"))).otherwise(0.0)
    return rows.select(
        (F.col("total_free_space") + F.col("allocated") == capacity).alias("space_accounting_valid"),
        (need <= metadata_bytes).alias("metadata_healthy"),
        F.round(share, 6).alias("fragmentation_percent"),
        F.lit(capacity).cast("long").alias("total_size"),
        F.col("used_bytes").alias("used_space"),
        F.col("total_free_space").alias("free_space"),
        need.cast("long").alias("metadata_size"),
        F.col("free_range_count"),
        F.col("largest_free_block"),
        F.col("average_fragment_size"),
        F.col("small_fragments"),
    )


def _record(columns: list[str]) -> Column:
    return F.unhex(F.concat(*(le_hex(F.coalesce(c, F.lit(0).cast("long"))) for c in columns)))


def _fields(raw: str, columns: list[str]) -> list[Column]:
    whole = F.octet_length(raw) == 8 * len(columns)
    numbers = le_numbers(F.col(raw), F.lit(0), F.when(whole, F.lit(len(columns))).otherwise(0))
    return [F.try_element_at(numbers, F.lit(i + 1)).alias(c) for i, c in enumerate(columns)]


_EXTENT_FIELDS = ["key", "range_start", "range_end", "id", "length", "size", "created_at", "modified_at"]
_RANGE_FIELDS = ["start", "end"]


def extent_records(extents: DataFrame) -> DataFrame:
    """``(id, record)``: extents as the metadata region holds them, 64 bytes each: the id as key, the range, the id again,
    length, size and times, 8 little-endian bytes each. A null number is 0."""
    return extents.withColumn("key", F.col("id")).select("id", _record(_EXTENT_FIELDS).alias("record"))


def read_extent_records(records: DataFrame, record: str = "record") -> DataFrame:
    """The extents of :func:`extent_records`; all fields are null for a record of another length."""
    return records.select(*_fields(record, _EXTENT_FIELDS)).drop("key")


def range_records(free: DataFrame) -> DataFrame:
    """``(start, record)``: free ranges as the metadata region holds them, 16 bytes each."""
    return free.select("start", _record(_RANGE_FIELDS).alias("record"))


def read_range_records(records: DataFrame, record: str = "record") -> DataFrame:
    """The free ranges of :func:`range_records`."""
    return records.select(*_fields(record, _RANGE_FIELDS))


def metadata_growth(free: DataFrame, extents: DataFrame, data_start: int, metadata_bytes: int = METADATA_BYTES) -> DataFrame:
    """One row on writing the metadata: ``(needed, metadata_bytes, growth, outcome)``.

    Metadata that outgrow their region get one of twice their size, taken from the free range at the start
    of the data. ``outcome`` is 'fits', 'grows', 'insufficient space' if that range is too small, or 'no
    adjacent space' if there is none there; ``growth`` is 0 unless it grows.
    """
    one = F.lit(1).alias("_one")
    ranges = free.agg(F.count("*").alias("ranges"), F.max(F.when(F.col("start") == data_start, F.col("end") - F.col("start"))).alias("beside"))
    rows = ranges.select("*", one).join(extents.agg(F.count("*").alias("extents")).select("*", one), "_one")
    need = (COUNT_BYTES + EXTENT_RECORD_BYTES * F.col("extents") + COUNT_BYTES + RANGE_RECORD_BYTES * F.col("ranges")).cast("long")
    more = 2 * need - metadata_bytes
    outcome = (
        F.when(need <= metadata_bytes, "fits").when(F.col("beside").isNull(), "no adjacent space").when(F.col("beside") >= more, "grows").otherwise("insufficient space")
    )
    grown = F.when(outcome == "grows", more).otherwise(0).cast("long")
    return rows.select(need.alias("needed"), (F.lit(metadata_bytes) + grown).cast("long").alias("metadata_bytes"), grown.alias("growth"), outcome.alias("outcome"))
