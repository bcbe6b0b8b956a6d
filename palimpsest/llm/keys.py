"""The identity of versioned records: namespace, padded key and version time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def namespace(ns: Column) -> Column:
    """Null is namespace 0."""
    return F.coalesce(ns.cast("long"), F.lit(0).cast("long"))


def plain_key(key: Column) -> Column:
    """``key`` (binary) without trailing 0x00 and 0x20 bytes; null stays null."""
    key = key.cast("binary")
    last = F.hex(F.substring(key, -1, 1))
    return F.when(last.isin("00", "20"), F.unhex(F.regexp_replace(F.hex(key), "(00|20)+$", ""))).otherwise(key)


def version_micros(ts: str) -> Column:
    """Microseconds of the version time in column ``ts``: in microseconds below 10^17, else in nanoseconds.

    0 (a pointer, no version) and null give null.
    """
    return F.expr(f"CASE WHEN `{ts}` = 0 THEN NULL WHEN `{ts}` < {10**17} THEN `{ts}` ELSE `{ts}` div 1000 END").cast("long")
