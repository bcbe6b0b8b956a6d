"""Range bounds over the log's order, as predicates that reach the Parquet scan.

A bound is a full version ``(ns, key, ts)``. Version times descend within a key, so a lower
bound on ``ts`` keeps the times at or below it. The predicates are spelt out with AND and OR
over single columns: comparisons of structs are not pushed down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: As the version time of a bound: before every version of the key, and after every one.
NEWEST: None = None
OLDEST = 0


@dataclass(frozen=True)
class Bound:
    """One side of a range; ``inclusive`` says whether the very version belongs to it."""

    ns: int
    key: bytes
    ts: int | None = NEWEST
    inclusive: bool = True


def included(ns: int, key: bytes, ts: int | None = NEWEST) -> Bound:
    return Bound(ns, key, ts, True)


def excluded(ns: int, key: bytes, ts: int | None = NEWEST) -> Bound:
    return Bound(ns, key, ts, False)


UNBOUNDED: None = None


def lower(bound: Bound | None) -> Column:
    """Rows at or after ``bound`` in the log's order."""
    if bound is None:
        return F.lit(True)
    ns, key = F.col("ns"), F.col("key")
    if bound.ts is None:
        same = F.lit(True)
    else:
        same = F.col("ts") <= bound.ts if bound.inclusive else F.col("ts") < bound.ts
    k = F.lit(bytearray(bound.key))
    # the first conjunct alone already bounds the scan by namespace
    return (ns >= bound.ns) & ((ns > bound.ns) | (key > k) | ((key == k) & same))


def upper(bound: Bound | None) -> Column:
    """Rows at or before ``bound`` in the log's order."""
    if bound is None:
        return F.lit(True)
    ns, key = F.col("ns"), F.col("key")
    if bound.ts is None:
        same = F.lit(False)
    else:
        same = F.col("ts") >= bound.ts if bound.inclusive else F.col("ts") > bound.ts
    k = F.lit(bytearray(bound.key))
    return (ns <= bound.ns) & ((ns < bound.ns) | (key < k) | ((key == k) & same))


def between(lo: Bound | None, hi: Bound | None) -> Column:
    """Rows within both bounds; an inverted range holds none."""
    return lower(lo) & upper(hi)
