"""The extent store's journal as a table: replay, retention, entry sizes.

Entries are rows ``(seq, entry_type, entry_time, frange_id, metadata, free_ranges)`` in the
order of ``seq``. Replay is a fold, told as aggregations: each deletion of an id ends an
epoch of that id, and an epoch's first creation is the extent, however often it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.running import islands, running_sum

# Codes of the entry types, and sizes of an entry's parts.
CREATE, DELETE, UPDATE, COALESCE = 1, 2, 3, 4
FRONT_BYTES = 18
METADATA_BYTES = 48
FLAG_BYTES = 1
COUNT_BYTES = 8
RANGE_BYTES = 16


def entry_bytes() -> Column:
    """The encoded size of an entry."""
    ranges = F.when(F.col("free_ranges").isNotNull(), COUNT_BYTES + RANGE_BYTES * F.size("free_ranges")).otherwise(0)
    return (FRONT_BYTES + F.when(F.col("metadata").isNotNull(), METADATA_BYTES).otherwise(0) + FLAG_BYTES + ranges).cast("long")


ENTRY_SCHEMA = (
    "seq long, entry_type tinyint, entry_time long, frange_id long, "
    "metadata struct<range_start:long,range_end:long,length:long,size:long,created_at:long,modified_at:long>, "
    "free_ranges array<struct<range_start:long,range_end:long>>"
)


def encode_entries(journal: DataFrame) -> DataFrame:
    """``(seq, entry)``: entries as JSON text, null parts left out."""
    names = ["seq", "entry_type", "entry_time", "frange_id", "metadata", "free_ranges"]
    return journal.select("seq", F.to_json(F.struct(*names)).alias("entry"))


def decode_entries(encoded: DataFrame, entry: str = "entry") -> DataFrame:
    """Entries from :func:`encode_entries`; ``problem`` is 'entry too short' for text that is no entry,
    'invalid entry type' for an unknown type, else null."""
    rows = encoded.select(F.from_json(entry, ENTRY_SCHEMA).alias("e")).select("e.*")
    kind = F.col("entry_type")
    problem = F.when(kind.isNull(), "entry too short").when(~kind.isin(CREATE, DELETE, UPDATE, COALESCE), "invalid entry type")
    return rows.withColumn("problem", problem)


def entry_sizes(journal: DataFrame) -> DataFrame:
    """``(seq, entry_type, bytes)`` of every entry."""
    return journal.select("seq", "entry_type", entry_bytes().alias("bytes"))


def retention(journal: DataFrame, capacity: int) -> DataFrame:
    """``(seq, bytes, bytes_from_end, kept)``: which entries a ring of ``capacity`` bytes still holds,
    the newest ones whose sizes together fit. An entry that no ring of that size holds is never kept
    and takes no room."""
    rows = journal.select("seq", entry_bytes().alias("bytes"))
    fits = F.col("bytes") <= capacity
    run = running_sum(rows, "seq", F.when(fits, F.col("bytes")), "bytes_from_end", descending=True)
    return run.select("seq", "bytes", "bytes_from_end", (fits & (F.col("bytes_from_end") <= capacity)).alias("kept"))


def epochs(journal: DataFrame) -> DataFrame:
    """``(id, epoch, created_seq, base, deleted_seq, updated)`` for each epoch of an id with a creation.

    ``base`` is the first creation's metadata, ``updated`` the last update after it, ``deleted_seq``
    the deletion that ended the epoch. Entries without an id do nothing, nor do creations and updates
    without metadata.
    """
    own = journal.filter(F.col("entry_type").isin(CREATE, DELETE, UPDATE) & F.col("frange_id").isNotNull())
    own = own.filter((F.col("entry_type") == DELETE) | F.col("metadata").isNotNull()).select("seq", "entry_type", "frange_id", "metadata")
    gone = F.when(F.col("entry_type") == DELETE, 1).otherwise(0)
    counted = running_sum(own, "seq", gone, "deletes", keys=["frange_id"]).withColumn("epoch", F.col("deletes") - gone)
    of = lambda kind, x: F.when(F.col("entry_type") == kind, x)
    entry = F.struct("seq", "metadata")
    # a deletion is the last entry of its epoch, and an update counts if it comes after the creation
    lives = counted.groupBy("frange_id", "epoch").agg(
        F.min(of(CREATE, entry)).alias("c"), F.min(of(DELETE, F.col("seq"))).alias("deleted_seq"), F.max(of(UPDATE, entry)).alias("u")
    )
    return lives.filter("c IS NOT NULL").select(
        F.col("frange_id").alias("id"), "epoch", F.col("c.seq").alias("created_seq"), F.col("c.metadata").alias("base"), "deleted_seq",
        F.when(F.col("u.seq") > F.col("c.seq"), F.col("u.metadata")).alias("updated"),
    )


def replay_extents(journal: DataFrame) -> DataFrame:
    """The extents after all entries: ``(id, range_start, range_end, length, size, created_at, modified_at)``.

    Updates change length and modification time only; those before a creation do nothing.
    """
    alive = epochs(journal).filter("deleted_seq IS NULL")
    return alive.select(
        "id",
        *(F.col(f"base.{c}").alias(c) for c in ("range_start", "range_end")),
        F.when(F.col("updated").isNotNull(), F.col("updated.length")).otherwise(F.col("base.length")).alias("length"),
        F.col("base.size").alias("size"),
        F.col("base.created_at").alias("created_at"),
        F.when(F.col("updated").isNotNull(), F.col("updated.modified_at")).otherwise(F.col("base.modified_at")).alias("modified_at"),
    )


def replay_free(journal: DataFrame, coalesced: bool = True) -> DataFrame:
    """The free ranges after all entries: those of the last coalescing entry, and the ranges of extents
    that were deleted after it; ``coalesced`` merges what touches."""
    last = journal.filter((F.col("entry_type") == COALESCE) & F.col("free_ranges").isNotNull()).agg(
        F.max(F.struct("seq", "free_ranges")).alias("l")
    )
    listed = last.select(F.explode("l.free_ranges").alias("r")).select(F.col("r.range_start").alias("start"), F.col("r.range_end").alias("end"))
    since = last.select(F.coalesce("l.seq", F.lit(-(2**62))).alias("since"), F.lit(1).alias("one"))
    freed = (
        epochs(journal).filter("deleted_seq IS NOT NULL").withColumn("one", F.lit(1)).join(F.broadcast(since), "one").filter("deleted_seq > since")
        .select(F.col("base.range_start").alias("start"), F.col("base.range_end").alias("end"))
    )
    rows = listed.unionByName(freed)
    return islands(rows, "start", "end") if coalesced else rows


def next_id(journal: DataFrame) -> DataFrame:
    """One row ``(next_id)``: one more than the largest id that was ever created, 0 without any; null
    after the largest id of a BIGINT, when none is left."""
    made = journal.filter((F.col("entry_type") == CREATE) & F.col("metadata").isNotNull())
    return made.agg(F.try_add(F.coalesce(F.max("frange_id"), F.lit(-1).cast("long")), F.lit(1).cast("long")).alias("next_id"))


def drift(replayed: DataFrame, stored: DataFrame) -> DataFrame:
    """``(id, problem)``: extents that a replay and the stored state disagree on: 'not stored',
    'not in journal', 'range', or 'length'."""
    a, b = replayed.alias("a"), stored.alias("b")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    problem = (
        F.when(F.col("b.id").isNull(), "not stored")
        .when(F.col("a.id").isNull(), "not in journal")
        .when(~(same("range_start") & same("range_end")), "range")
        .when(~same("length"), "length")
    )
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    return both.select(F.coalesce("a.id", "b.id").alias("id"), problem.alias("problem")).filter("problem IS NOT NULL")
