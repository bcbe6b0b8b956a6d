"""Segments as tables of blocks: where blocks go, and reading them in order or from a position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import InvalidSegmentSize
from palimpsest.functions.pages import BLOCK_BYTES
from palimpsest.functions.running import running_sum


def layout(blocks: DataFrame, segment: str, order: str, segment_bytes: int | None = None) -> DataFrame:
    """``segment, order, block_no, offset, stored``: blocks of a segment lie one after another in ``order``.

    A segment of ``segment_bytes`` holds that many bytes of blocks; later ones are not stored. Each
    distinct ``(segment, order)`` is one block; ``order`` is a bigint. Without a size segments are unlimited.
    """
    if segment_bytes is not None and segment_bytes % BLOCK_BYTES:
        raise InvalidSegmentSize(f"{segment_bytes} is no multiple of {BLOCK_BYTES}")
    counted = running_sum(blocks.select(segment, order).distinct(), order, F.lit(1), "_n", keys=[segment])
    placed = counted.withColumn("block_no", F.col("_n") - 1).drop("_n").withColumn("offset", F.col("block_no") * BLOCK_BYTES)
    room = F.lit(True) if segment_bytes is None else F.col("offset") + BLOCK_BYTES <= segment_bytes
    return placed.withColumn("stored", room)


def read_block(stored: DataFrame, segment_id: int | None, block_no: int, segment: str = "segment_id") -> DataFrame:
    """One block of a segment, or with None of every one: a row, or none out of bounds."""
    at = stored.filter(F.col("block_no") == block_no)
    return at if segment_id is None else at.filter(F.col(segment) == segment_id)


def seek(stored: DataFrame, block_no: int, segment: str = "segment_id") -> DataFrame:
    """The blocks of every segment from ``block_no`` on, in order."""
    return stored.filter(F.col("block_no") >= block_no).orderBy(segment, "block_no")


def remaining(stored: DataFrame, position: int, segment: str = "segment_id") -> DataFrame:
    """``segment, blocks, blocks_remaining``: blocks held, and those at ``position`` or later."""
    return stored.groupBy(segment).agg(F.count("*").alias("blocks"), F.count_if(F.col("block_no") >= position).alias("blocks_remaining"))


def segment_stats(stats: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Per segment, from :func:`palimpsest.operators.blocks.block_stats`: ``segment, blocks, entries, bytes,
    fill_percent, wrong_counts``."""
    return stats.groupBy(segment).agg(
        F.count("*").alias("blocks"),
        F.sum("entries_held").cast("long").alias("entries"),
        F.sum("bytes").cast("long").alias("bytes"),
        F.round(100 * F.sum("bytes") / (F.count("*") * BLOCK_BYTES), 2).alias("fill_percent"),
        F.count_if(F.coalesce(~F.col("count_ok"), F.lit(True))).alias("wrong_counts"),
    )
