"""Per-key results over inputs in which a few keys hold most rows.

Eager aggregation through joins: each input is reduced to one compact state per key before
any row meets another, and the states are joined. What a join of the rows would have
counted or summed follows from the states: a key with m rows left and n rows right has m*n
joined rows, and a left sum appears n times in it. Tasks reduce
their rows before the shuffle, so a hot key arrives as one partial state per task and no row
of it is shuffled on its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Sums and products over joined rows outgrow a bigint long before the inputs are large.
EXACT = "decimal(38,0)"


def key_states(rows: DataFrame, key: Column, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """``(key, n, <sum names>)``: rows per key and sums of the given bigint expressions, as decimals.

    A null key is a key of its own here; callers that merge it into another pass a coalesce.
    Null summands count as 0. Spark aggregates each task's rows before the shuffle, so a key
    that holds a third of all rows arrives as one partial state per task.
    """
    sums = sums or {}
    flat = rows.select(key.alias("key"), *(c.cast("long").cast("decimal(20,0)").alias(n) for n, c in sums.items()))
    return flat.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(n), F.lit(0)).cast(EXACT).alias(n) for n in sums)
    )


def joined_states(
    left: DataFrame, right: DataFrame, left_sums: tuple[str, ...] = (), right_sums: tuple[str, ...] = (), how: str = "inner"
) -> DataFrame:
    """What joining the rows behind two tables of key states on their key would give, per key:
    ``left_n``, ``right_n``, ``pairs``, and every sum over the joined rows, the last two exact as DECIMAL(38,0).

    Keys match null-safely. Keys on one side only give no row, as in an inner join, or with
    ``how="full_outer"`` a row with 0 on the other side.
    """
    left = left.select(F.col("key").alias("lkey"), F.col("n").alias("left_n"), *(F.col(c).alias(f"left_{c}") for c in left_sums))
    right = right.select(F.col("key").alias("rkey"), F.col("n").alias("right_n"), *(F.col(c).alias(f"right_{c}") for c in right_sums))
    both = left.join(right, left["lkey"].eqNullSafe(right["rkey"]), how)
    n = {side: F.coalesce(F.col(f"{side}_n"), F.lit(0)) for side in ("left", "right")}
    # as wide as it takes, without the digits after the point that a product of decimals would keep
    times = lambda c, by: (F.coalesce(F.col(c), F.lit(0)).cast(EXACT) * by.cast("decimal(19,0)")).cast(EXACT)
    return both.select(
        F.coalesce("lkey", "rkey").alias("key"),
        n["left"].alias("left_n"),
        n["right"].alias("right_n"),
        times("left_n", n["right"]).alias("pairs"),
        *(times(f"left_{c}", n["right"]).alias(c) for c in left_sums),
        *(times(f"right_{c}", n["left"]).alias(c) for c in right_sums),
    )


def heavy_keys(joined: DataFrame, percent: int) -> DataFrame:
    """``(side, key, n, total)``: the keys that hold at least ``percent`` % of all rows of the left or of the
    right input, from their full outer :func:`joined_states`. The comparison is exact; an empty input
    has no heavy key."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_n").alias("n")) for s in ("left", "right"))))
    states = joined.select("key", sides.alias("s")).select("s.side", "key", "s.n").filter("n > 0")
    totals = states.groupBy("side").agg(F.sum("n").alias("total"))
    return states.join(totals, "side").filter(F.col("n").cast(EXACT) * 100 >= F.col("total").cast(EXACT) * percent).select("side", "key", "n", "total")


def namespace_entries(index: DataFrame) -> DataFrame:
    """One row per entry of ``ns_offsets``: ``(ns, block_offset)``; null and empty lists have none."""
    return index.select(F.explode("ns_offsets").alias("e")).select(F.col("e.ns").alias("ns"), F.col("e.block_offset").alias("block_offset"))


def heavy_namespaces(log: DataFrame, index: DataFrame, percent: int = 5) -> DataFrame:
    """``(in_table, ns)``: namespaces with at least ``percent`` % of a table's rows or entries.

    Both counts, and the totals, come from the joined states of the two tables. Empty tables, and
    lists that are null or empty, have no namespaces. Repeated rows count each. Columns other than
    ``ns`` and ``ns_offsets`` are not read.
    """
    ns = F.coalesce("ns", F.lit(0).cast("long"))
    joined = joined_states(key_states(log, ns), key_states(namespace_entries(index), ns), how="full_outer")
    name = F.when(F.col("side") == "left", "version_log").otherwise("segment_index")
    return heavy_keys(joined, percent).select(name.alias("in_table"), F.col("key").alias("ns"))


def namespace_profile(log: DataFrame, index: DataFrame) -> DataFrame:
    """Per namespace, what the join of all its log rows with all its index entries holds:
    ``(ns, log_rows, index_entries, pairs, val_bytes, blocks)``, the last two summed over the pairs."""
    ns = F.coalesce("ns", F.lit(0).cast("long"))
    left = key_states(log, ns, {"val_bytes": F.octet_length("val")})
    right = key_states(namespace_entries(index), ns, {"blocks": F.floor(F.col("block_offset") / 4096)})
    return joined_states(left, right, ("val_bytes",), ("blocks",)).select(
        F.col("key").alias("ns"), F.col("left_n").alias("log_rows"), F.col("right_n").alias("index_entries"), "pairs", "val_bytes", "blocks"
    )
