"""Sparse indexes over sorted runs, membership of keys, and checks of stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codecs import le_hex, le_numbers
from palimpsest.functions.numbering import greatest_so_far, with_position
from palimpsest.model import IDENTITY, total_order


def blocked(log: DataFrame, rows_per_block: int) -> DataFrame:
    """The log in its order with ``pos`` (from 0) and the ``block_no`` it falls into."""
    placed = with_position(log, total_order(), "pos", first=0)
    return placed.withColumn("block_no", F.expr(f"pos div {rows_per_block}"))


def sparse_index(blocks: DataFrame) -> DataFrame:
    """``(block_no, ns, key, ts, rows)``: the first version of every block, and how many it holds."""
    first = F.min(F.struct("pos", "ns", "key", "ts")).alias("f")
    return blocks.groupBy("block_no").agg(first, F.count("*").alias("rows")).select("block_no", "f.ns", "f.key", "f.ts", "rows")


def namespace_offsets(blocks: DataFrame) -> DataFrame:
    """``(ns, first_block, last_block, rows)``: the blocks that hold a namespace."""
    return blocks.groupBy("ns").agg(F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"), F.count("*").alias("rows"))


def lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """``(ns, key, block_no)``: for each distinct probe the block to begin reading at, null before the first.

    That is the last block whose first version comes before the probe's newest one; the key's own
    versions may also begin in the next block. Index and probes are merged in one order.
    """
    # a block that starts with the key itself does not lie before the key's newest version
    starts = index.select("ns", "key", F.lit(1).alias("start"), "block_no")
    asked = probes.select(F.col("ns").cast("long").alias("ns"), F.col("key").cast("binary").alias("key")).distinct()
    rows = starts.unionByName(asked.select("ns", "key", F.lit(0).alias("start"), F.lit(None).cast("long").alias("block_no")))
    found = greatest_so_far(rows, [F.col("ns"), F.col("key"), F.col("start")], "block_no", "last")
    return found.filter("start = 0").select("ns", "key", F.col("last").alias("block_no"))


def key_hash(seed: Column | int = 0) -> Column:
    """A seeded 64-bit hash of ``(ns, key)``."""
    s = F.lit(seed).cast("long") if isinstance(seed, int) else seed
    return F.xxhash64(s, F.col("ns"), F.col("key"))


def members(probes: DataFrame, log: DataFrame) -> DataFrame:
    """Probes whose ``(ns, key)`` the log has in any version, tombstones included."""
    return probes.join(log.select(*IDENTITY), IDENTITY, "left_semi")


def non_members(probes: DataFrame, log: DataFrame) -> DataFrame:
    """Probes whose ``(ns, key)`` the log has in no version; a probe with a null key is one."""
    return probes.join(log.select(*IDENTITY), IDENTITY, "left_anti")


def stored_index_checks(segment_index: DataFrame) -> DataFrame:
    """``(row_id, entries, namespaces, blocks, size_ok, ascending, dangling)`` of every stored index row:
    whether its stated numbers hold, whether namespaces ascend, and how many entries name a block
    offset that the row does not list. Null lists count as empty."""
    ns_offsets = F.coalesce("ns_offsets", F.expr("cast(array() as array<struct<ns:bigint,block_offset:bigint>>)"))
    blocks = F.coalesce("block_offsets", F.expr("cast(array() as array<bigint>)"))
    rows = segment_index.select("row_id", "ns_offset_size", "block_offset_size", ns_offsets.alias("o"), blocks.alias("b"))
    names = F.transform("o", lambda e: e["ns"])
    # by hash; only what is left is looked for entry by entry
    unlisted = F.array_except(F.transform("o", lambda e: e["block_offset"]), F.col("b"))
    rows = rows.withColumn("u", unlisted)
    return rows.select(
        "row_id",
        F.size("o").alias("entries"),
        F.size(F.array_distinct(names)).alias("namespaces"),
        F.size("b").alias("blocks"),
        ((F.col("ns_offset_size") == F.size("o")) & (F.col("block_offset_size") == F.size("b"))).alias("size_ok"),
        (F.array_sort(names) == names).alias("ascending"),
        F.size(F.filter("o", lambda e: F.array_contains(F.col("u"), e["block_offset"]))).alias("dangling"),
    )


# The byte form of a stored index: seven numbers of 8 bytes (id, seed and size of the filter, its place, how many
# namespace entries and block offsets follow, and a bit for each of the first three that is null), then the
# block offsets, then namespace and block offset of every entry. All numbers are little endian.
HEAD_NUMBERS = 7


def encode_index(segment_index: DataFrame) -> DataFrame:
    """``(row_id, raw)``: stored index rows in their byte form. The numbers of entries are those that the row has,
    whatever it states. Null lists count as empty; a null within them is 0."""
    ns_offsets = F.coalesce("ns_offsets", F.expr("cast(array() as array<struct<ns:bigint,block_offset:bigint>>)"))
    blocks = F.coalesce("block_offsets", F.expr("cast(array() as array<bigint>)"))
    zero = F.lit(0).cast("long")
    head = ["id", "bloom_filter_seed", "bloom_filter_size"]
    mask = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(head)), F.lit(0))
    rows = segment_index.select("row_id", *head, ns_offsets.alias("o"), blocks.alias("b"), mask.alias("mask"))
    numbers = [*(F.coalesce(c, zero) for c in head), zero, F.size("o"), F.size("b"), F.col("mask")]
    entries = F.transform("o", lambda e: F.concat(le_hex(F.coalesce(e["ns"], zero)), le_hex(F.coalesce(e["block_offset"], zero))))
    offsets = F.transform("b", lambda x: le_hex(F.coalesce(x, zero)))
    return rows.select("row_id", F.unhex(F.concat(*map(le_hex, numbers), F.array_join(offsets, ""), F.array_join(entries, ""))).alias("raw"))


def decode_index(encoded: DataFrame, raw: str = "raw") -> DataFrame:
    """``(row_id, id, bloom_filter_seed, bloom_filter_size, block_offsets, ns_offsets, problem)`` of :func:`encode_index`;
    ``problem`` is 'corrupt' and the rest null where the length is not what the numbers say."""
    rows = encoded.select("row_id", F.col(raw).alias("h"), F.octet_length(raw).alias("n"))
    at = lambda i: F.try_element_at(F.col("head"), F.lit(i + 1))
    rows = rows.withColumn("head", le_numbers(F.col("h"), F.lit(0), F.when(F.col("n") >= 8 * HEAD_NUMBERS, HEAD_NUMBERS).otherwise(0)))
    whole = F.coalesce((at(4) >= 0) & (at(5) >= 0) & (F.col("n") == 8 * (HEAD_NUMBERS + at(5) + 2 * at(4))), F.lit(False))
    rows = rows.withColumn("ok", whole)
    held = lambda i, bit: F.when(F.col("ok") & (at(6).bitwiseAND(1 << bit) == 0), at(i))
    blocks = F.when(F.col("ok"), le_numbers(F.col("h"), F.lit(HEAD_NUMBERS), at(5)))
    flat = le_numbers(F.col("h"), HEAD_NUMBERS + at(5), 2 * at(4))
    pairs = F.when(at(4) > 0, F.transform(F.sequence(F.lit(0), (at(4) - 1).cast("int")), lambda i: F.struct(F.element_at("flat", (2 * i + 1).cast("int")).alias("ns"), F.element_at("flat", (2 * i + 2).cast("int")).alias("block_offset"))))
    none = F.expr("cast(array() as array<struct<ns:bigint,block_offset:bigint>>)")
    return rows.withColumn("flat", F.when(F.col("ok"), flat)).select(
        "row_id", held(0, 0).alias("id"), held(1, 1).alias("bloom_filter_seed"), held(2, 2).alias("bloom_filter_size"), blocks.alias("block_offsets"),
        F.when(F.col("ok"), F.coalesce(pairs, none)).alias("ns_offsets"), F.when(~F.col("ok"), "corrupt").alias("problem"),
    )
