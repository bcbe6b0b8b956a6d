"""Packing items of varying length into blocks of fixed capacity.

Sum-of-squares packing: every open block has a residual gap, and an item goes where the sum,
over all gaps, of the squared number of open blocks with that gap becomes smallest; among
equal choices into the fullest block, and into a new block only if that is smaller still.
Items come longest first. While that misses a lower bound, the items of the worst filled blocks
are packed anew in orders near longest-first, by the same rule for any number of items; of a
small segment those are all its blocks. An item longer than a block's payload is the only one
that is cut: its full pieces take blocks of their own and its rest is packed like any other item.

A segment's blocks are packed in one task up to ``PART_ITEMS`` entries or ``PART_BYTES`` bytes;
larger segments are split into parts by a hash of the block, each packed by itself. A part
costs about one block, seldom two, more than the segment as a whole would take; ``packing_report``
gives the parts and the least number of blocks.

Payloads are moved once. What repeats exactly is told by 128 bits of hash, within each task
before and within each part after.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.pages import BLOCK_BYTES, COUNT_BYTES, ENTRY_BYTES, FLAG_BYTES, MAX_PAYLOAD, OFFSET_BYTES, ROOM, cut, page

PART_ITEMS = 200_000
PART_BYTES = 64_000_000
#: Orders tried, and the worst filled blocks whose items are packed anew in each.
TRIES = 120
WORST = 64
#: Up to so many different gaps they are looked through one by one, else all sizes at once; the choice is the same.
FEW_GAPS = 40


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, in the order given, and the number of bins.

    Every size must lie between 1 and ``capacity``.
    """
    count = np.zeros(capacity + 1, dtype=np.int32)
    bins: dict[int, list[int]] = {}
    where = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        # change of the sum when a block of gap g takes the item; a full block is open no more
        best, gap = 2 * len(bins.get(capacity - size, ())) + 1 if size < capacity else 0, capacity
        if len(bins) < FEW_GAPS:
            for g, held in bins.items():
                if g >= size:
                    change = 1 - 2 * len(held) + (2 * len(bins.get(g - size, ())) + 1 if g > size else 0)
                    if change < best or change == best and g < gap:
                        best, gap = change, g
        else:
            own = count[size:capacity]
            after = 2 * count[: capacity - size] + 1
            after[:1] = 0
            change = np.where(own > 0, 1 - 2 * own + after, np.iinfo(np.int32).max)
            k = int(change.argmin()) if len(change) else -1
            if k >= 0 and change[k] <= best:
                gap = size + k
        if gap < capacity:
            b = bins[gap].pop()
            count[gap] -= 1
            if not bins[gap]:
                del bins[gap]
        else:
            b = made
            made += 1
        gap -= size
        where[i] = b
        if gap:
            count[gap] += 1
            bins.setdefault(gap, []).append(b)
    return where, made


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: a bound from the sizes' sum, and from the items of which two
    never share a bin along with what does not fit beside the largest of them."""
    order = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(order)])
    small = np.unique(np.concatenate([[0], order[order <= capacity // 2]]))
    at = lambda x: np.searchsorted(order, x, "right")
    half, alone = at(capacity // 2), at(capacity - small)
    alone = np.maximum(alone, half)
    rest = total[half] - total[np.searchsorted(order, small, "left")]
    free = (alone - half) * capacity - (total[alone] - total[half])
    by_pairs = len(order) - half + np.maximum(0, -(-(rest - free) // capacity))
    return int(max(-(-total[-1] // capacity), by_pairs.max()))


def _ordered(sizes: np.ndarray, capacity: int, order: np.ndarray) -> tuple[np.ndarray, int]:
    where = np.empty(len(sizes), dtype=np.int64)
    where[order], made = sum_of_squares(sizes[order], capacity)
    return where, made


def best_packing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """``(bin of each item, bins)``: longest first and, where that misses the bound of :func:`least_bins`, in chance
    order, whichever is better; then with the items of the ``WORST`` worst filled bins packed anew in
    ``TRIES`` orders between the two, until the bound is met."""
    where, made = _ordered(sizes, capacity, np.argsort(-sizes, kind="stable"))
    bound = least_bins(sizes, capacity) if len(sizes) else 0
    rng = np.random.default_rng(len(sizes))
    if made > bound:
        other = _ordered(sizes, capacity, rng.permutation(len(sizes)))
        where, made = other if other[1] < made else (where, made)
    for t in range(1, TRIES):
        if made <= bound:
            break
        fill = np.bincount(where, weights=sizes, minlength=made)
        # a little chance picks other bins among those that are filled alike
        worst = np.argsort(fill + rng.uniform(0, capacity * t / TRIES / 8, made), kind="stable")[:WORST]
        chosen = np.zeros(made, bool)
        chosen[worst] = True
        again = np.flatnonzero(chosen[where])
        own = sizes[again]
        least = 1 - t / TRIES
        new, n = _ordered(own, capacity, np.argsort(-own * rng.uniform(least, 1, len(own)), kind="stable"))
        if n <= len(worst):
            kept = made - len(worst)
            where = (np.cumsum(~chosen) - 1)[where]
            where[again] = new + kept
            made = kept + n
    return where, made


def pack(lengths: Sequence[int]) -> list[list[tuple[int, int, int]]]:
    """Blocks as lists of ``(payload, piece, flag)``, each in the order of the payloads, of payloads of the given lengths."""
    pieces = [(i, k, end - start, flag) for i, n in enumerate(lengths) for k, (start, end, flag) in enumerate(cut(n))]
    where, made = best_packing(np.array([n + ENTRY_BYTES for _, _, n, _ in pieces], dtype=np.int64), ROOM)
    blocks: list[list[tuple[int, int, int]]] = [[] for _ in range(made)]
    for (i, k, _, flag), b in zip(pieces, where.tolist()):
        blocks[b].append((i, k, flag))
    return blocks


_OUT = (
    "segment_id long, part int, block_no int, num_entries int, used_bytes int, offsets array<int>, flags array<int>, "
    "entries array<binary>, sources array<struct<block_id:long,slot:int,piece:int>>"
)
_ARROW = pa.schema([
    ("segment_id", pa.int64()), ("part", pa.int32()), ("block_no", pa.int32()), ("num_entries", pa.int32()), ("used_bytes", pa.int32()),
    ("offsets", pa.list_(pa.int32())), ("flags", pa.list_(pa.int32())), ("entries", pa.list_(pa.binary())),
    ("sources", pa.list_(pa.struct([("block_id", pa.int64()), ("slot", pa.int32()), ("piece", pa.int32())]))),
])


def _first_of_each(rows: pa.RecordBatch | pa.Table, met: set[tuple]) -> pa.Array:
    """Places of the rows that repeat none in ``met``, which they join."""
    at = []
    for i, name in enumerate(zip(*(rows.column(c).to_pylist() for c in ("segment_id", "block_id", "d1", "d2")))):
        if name not in met:
            met.add(name)
            at.append(i)
    return pa.array(at, pa.int64())


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: set[tuple] = set()
    for batch in batches:
        yield batch.take(_first_of_each(batch, met))


def _pack_part(part: pa.Table) -> pa.Table:
    part = part.take(_first_of_each(part, set())).sort_by([("block_id", "ascending"), ("d1", "ascending"), ("d2", "ascending")]).combine_chunks()
    segment, number = part.column("segment_id")[0].as_py(), part.column("part")[0].as_py()
    lists = part.column("entries").combine_chunks()
    row = pc.list_parent_indices(lists).to_numpy()
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    slot = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    payload = lists.flatten()
    held = np.flatnonzero(payload.is_valid().to_numpy(zero_copy_only=False))
    payload, row, slot = payload.take(pa.array(held)), row[held], slot[held]
    blocks = pack(pc.binary_length(payload).to_pylist())
    flat = [x for b in blocks for x in b]
    i, k, flag = (np.array([x[c] for x in flat], dtype=np.int64) for c in range(3))
    # whole entries are taken as they are, pieces of longer ones are cut out
    cuts = np.flatnonzero(flag)
    pieces = [payload[int(i[j])].as_py()[k[j] * MAX_PAYLOAD : (k[j] + 1) * MAX_PAYLOAD] for j in cuts]
    source = i.copy()
    source[cuts] = len(payload) + np.arange(len(cuts))
    entries = pa.concat_arrays([payload, pa.array(pieces, payload.type)]).take(pa.array(source))
    number_of = np.array([len(b) for b in blocks], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(number_of)])
    ends = np.cumsum(pc.binary_length(entries).to_numpy(zero_copy_only=False) + FLAG_BYTES)
    ends -= np.repeat(np.concatenate([[0], ends])[bounds[:-1]], number_of)
    offsets = pa.array(bounds, pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(offsets, x)
    block_id = part.column("block_id").combine_chunks().take(pa.array(row[i]))
    sources = pa.StructArray.from_arrays([block_id, pa.array(slot[i], pa.int32()), pa.array(k, pa.int32())], names=["block_id", "slot", "piece"])
    n = len(blocks)
    used = COUNT_BYTES + OFFSET_BYTES * number_of + (ends[bounds[1:] - 1] if n else ends)
    return pa.Table.from_arrays([
        pa.array([segment] * n, pa.int64()), pa.array([number] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(number_of, pa.int32()),
        pa.array(used, pa.int32()), listed(pa.array(ends, pa.int32())), listed(pa.array(flag, pa.int32())), listed(entries.cast(pa.binary())), listed(sources),
    ], schema=_ARROW)


def repack(blocks: DataFrame) -> DataFrame:
    """The entries of each segment laid out anew: ``segment_id, part, block_no, num_entries, used_bytes,
    offsets, flags, entries, sources``, one row per new block.

    A row that repeats another one exactly is the same block and counts once. A null entry has no
    payload and takes no place; an empty one is an entry of length 0. ``num_entries`` and ``offsets`` are
    not relied on. ``offsets`` of the result are end offsets, flag byte included; ``sources`` says which
    entry, and which piece of it, each new entry is. A null segment is a segment of its own. Rows of
    null or empty entries, and empty tables, give no blocks. Two different rows of one block id are
    both laid out. Other columns are not read.
    """
    same = ["segment_id", "block_id", "num_entries", "offsets", "entries"]
    rows = blocks.select(
        F.col("segment_id").cast("long").alias("segment_id"), F.col("block_id").cast("long").alias("block_id"),
        F.xxhash64(*same).alias("d1"), F.xxhash64(F.lit(1), *same).alias("d2"), "entries",
    ).filter("size(entries) > 0")
    lengths = F.transform("entries", lambda e: F.coalesce(F.octet_length(e).cast("long"), F.lit(0).cast("long")))
    bytes_held = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    # only sizes are moved to see which segments are large; each of those holds a part's bytes or entries, so they are few
    sizes = rows.groupBy("segment_id", "block_id", "d1", "d2").agg(F.max(F.size("entries")).alias("n"), F.max(bytes_held).alias("bytes"))
    parts = F.greatest(F.ceil(F.sum("n") / PART_ITEMS), F.ceil(F.sum("bytes") / PART_BYTES)).cast("int")
    large = sizes.groupBy(F.col("segment_id").alias("s")).agg(parts.alias("parts")).filter("parts > 1")
    once = rows.mapInArrow(_once_per_task, rows.schema)
    number = F.pmod(F.xxhash64("block_id", "d1", "d2"), F.coalesce("parts", F.lit(1))).cast("int")
    parted = once.join(F.broadcast(large), once["segment_id"].eqNullSafe(large["s"]), "left").withColumn("part", number)
    return parted.select("segment_id", "part", "block_id", "d1", "d2", "entries").groupBy("segment_id", "part").applyInArrow(_pack_part, _OUT)


def packing_report(packed: DataFrame) -> DataFrame:
    """Per segment: ``segment_id, parts, blocks, entries, used_bytes, least_blocks, fill_percent``, where
    ``least_blocks`` is what the entries' bytes would fill without any gap. Of the blocks beyond it, about
    one for each part may be owed to the cut into parts."""
    return packed.groupBy("segment_id").agg(
        F.count_distinct("part").alias("parts"), F.count("*").alias("blocks"), F.sum("num_entries").alias("entries"), F.sum("used_bytes").alias("used_bytes"),
        F.ceil(F.sum(F.col("used_bytes") - COUNT_BYTES) / ROOM).alias("least_blocks"),
        F.round(100 * F.sum("used_bytes") / (F.count("*") * BLOCK_BYTES), 2).alias("fill_percent"),
    )


def rendered(packed: DataFrame) -> DataFrame:
    """The new blocks as ``segment_id, part, block_no, page``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["flags", "entries"]).to_pylist()
            pages = pa.array([page(r["flags"], r["entries"]) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pages], names=["segment_id", "part", "block_no", "page"])

    return packed.drop("sources").mapInArrow(run, "segment_id long, part int, block_no int, page binary")
