"""Files of consecutive slotted blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.pages import BLOCK_BYTES


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block_no, page)`` of every block of the files at ``path``.

    A file is read whole by one task, so files should be segments of bounded size. What is left of a
    file after its last whole block is a short page, which decoding reports as corrupt.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {BLOCK_BYTES}"))
    rows = files.select(F.col("path").alias("file"), "content", F.explode(blocks).alias("block_no"))
    page = F.col("content").substr((F.col("block_no") * BLOCK_BYTES + 1).cast("int"), F.lit(BLOCK_BYTES))
    return rows.select("file", "block_no", page.alias("page"))
