"""Slotted blocks as tables: cutting values, filling blocks in order, block statistics, raw pages.

Blocks are rows ``(block_id, ..., entries ARRAY<BINARY>)``; a null entry holds no payload.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.errors import CorruptBlock
from palimpsest.functions import pages
from palimpsest.functions.numbering import ranged
from palimpsest.functions.pages import BLOCK_BYTES, CAPACITY, COUNT_BYTES, ENTRY_BYTES, FLAG_BYTES, MAX_PAYLOAD
from palimpsest.functions.running import with_carry


def piece_flag(piece: Column, pieces: Column) -> Column:
    """0 for a whole entry, else 1 for the first, 2 for a middle and 3 for the last piece."""
    return F.when(pieces == 1, pages.COMPLETE).when(piece == 0, pages.START).when(piece == pieces - 1, pages.END).otherwise(pages.MIDDLE)


def chunks(values: DataFrame, id_cols: list[str], value: str = "value", size: int = MAX_PAYLOAD) -> DataFrame:
    """Every value in pieces of ``size`` bytes: ``id_cols, piece, flag, payload``.

    An empty value is one empty piece; null values give none.
    """
    n = F.greatest(F.ceil(F.octet_length(value) / size), F.lit(1)).cast("int")
    rows = values.filter(F.col(value).isNotNull()).select(*id_cols, F.col(value).cast("binary").alias("_v"), n.alias("_n"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select(*id_cols, "piece", piece_flag(F.col("piece"), F.col("_n")).alias("flag"), F.col("_v").substr(F.col("piece") * size + 1, F.lit(size)).alias("payload"))


def joined_chunks(parts: DataFrame, id_cols: list[str]) -> DataFrame:
    """The values that :func:`chunks` cut: ``id_cols, value``."""
    whole = F.array_sort(F.collect_list(F.struct("piece", F.hex("payload").alias("h"))))
    return parts.groupBy(*id_cols).agg(whole.alias("p")).select(*id_cols, F.unhex(F.array_join(F.transform("p", lambda p: p["h"]), "")).alias("value"))


def _next_starts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the sizes before each entry, and where the next block starts if one starts at each entry."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    after = np.searchsorted(before, before[:-1] + capacity, "right") - 1
    return before, np.maximum(after, np.arange(len(sizes)) + 1)


def _passed_through(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """What becomes of a block that is open at the first entry, for every entry ``j`` before which it may be the
    first that does not fit: ``(room, used, slots, blocks)``, where ``room`` is what fits before ``j``, and the others
    are bytes and entries in the block that is open at the end, and blocks opened till there."""
    m = len(sizes)
    before, after = _next_starts(sizes, capacity)
    # all blocks from a start on, by doubling: the last start, and how many there are
    last, count, step = np.arange(m), np.ones(m, np.int64), np.minimum(after, m)
    hop, n = step.copy(), np.ones(m, np.int64)
    while (hop < m).any():
        on = hop < m
        last[on], count[on] = last[hop[on]], count[on] + count[hop[on]]
        hop[on] = hop[hop[on]]
    j = np.arange(min(m, int(np.searchsorted(before, capacity, "right"))))
    return before[j], before[m] - before[last[j]], m - last[j], count[j]


def fill_in_order(entries: DataFrame, run: str, order: str | list[str], size: Column, capacity: int = CAPACITY) -> DataFrame:
    """Blocks filled one after another, as a writer does: ``run, order, bytes, block_no, slot``.

    Each run's entries go, in ``order`` (a column or several), into the current block while they fit and otherwise open a
    new one. ``size`` is the payload's length; entries longer than a block's payload must have been cut
    (:func:`chunks`), and are given a block of their own here. Entries without a size are left out.

    A run of any length is filled in many tasks. Entries are range-partitioned; for a part of a run
    that goes on, it is told how any block that is open when it begins is left when it ends. That
    depends on the first entry that does not fit only, so it is a short table, and following these
    tables from part to part gives the block that each of them finds open.
    """
    by = {f"ord{i}": c for i, c in enumerate([order] if isinstance(order, str) else order)}
    rows = entries.select(F.col(run).alias("run"), *(F.col(c).alias(o) for o, c in by.items()), size.cast("int").alias("bytes")).filter("bytes IS NOT NULL")
    kinds = rows.schema
    cut = ranged(rows, [F.col("run"), *(F.col(o) for o in by)])
    kind = kinds["run"].dataType.simpleString()

    def in_order(batches: Iterator[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(list(batches)).sort_by([(o, "ascending") for o in by])

    def pass_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = in_order(batches)
        sizes = table.column("bytes").to_numpy().astype(np.int64) + ENTRY_BYTES
        tables = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in _passed_through(sizes, capacity)]
        ends = [pa.array([n], pa.int64()) for n in (int(sizes.sum()), len(sizes))]
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks()[:1] for c in ("run", "_part")), *tables, *ends], names=["run", "_part", *_TABLE])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("_part")
        state, found = (0, 0, 0), []
        for room, used, slots, blocks, total, n in zip(*(table.column(c).to_pylist() for c in _TABLE)):
            found.append(state)
            open_bytes, open_slots, block = state
            # the first entry that does not fit; of a block still empty any entry is the first
            j = 0 if not open_slots else max(bisect.bisect_right(room, capacity - open_bytes) - 1, 0)
            if not open_slots:
                state = (used[0], slots[0], block + blocks[0] - 1)
            elif j == len(room) - 1 and open_bytes + total <= capacity:
                state = (open_bytes + total, open_slots + n, block)
            else:
                state = (used[j], slots[j], block + blocks[j])
        names = ["open_bytes", "open_slots", "open_block"]
        cols = [pa.array(c, pa.int64()) for c in zip(*found)]
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("run", "_part")), *cols], names=["run", "_part", *names])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = in_order(batches)
        sizes = table.column("bytes").to_numpy().astype(np.int64) + ENTRY_BYTES
        open_bytes, open_slots, block = (table.column(c)[0].as_py() or 0 for c in ("open_bytes", "open_slots", "open_block"))
        before, after = _next_starts(sizes, capacity)
        at = max(int(np.searchsorted(before, capacity - open_bytes, "right")) - 1, 0) if open_slots else 0
        starts = []
        while at < len(sizes):
            starts.append(at)
            at = int(after[at])
        number = np.zeros(len(sizes), np.int64)
        number[starts] = 1
        number = np.cumsum(number)
        first = np.array([-open_slots, *starts])
        slot = np.arange(len(sizes)) - first[number]
        # a run's first block counts as the one that was open
        out = table.append_column("block_no", pa.array(block + number - (0 if open_slots else 1))).append_column("slot", pa.array(slot, pa.int32()))
        yield from out.select(["run", *by, "bytes", "block_no", "slot"]).to_batches()

    sizes_of = cut.groupBy("run", "_part").agg(F.count(F.lit(1)).alias("n"))
    going_on = sizes_of.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy("run"))).filter("_parts > 1")
    going_on = going_on.select(F.col("run").alias("_k0"), F.col("_part").alias("_kpart"), F.lit(True).alias("_on"))
    wide = with_carry(cut, going_on, ["run"]).filter("_on").drop("_on")
    tables = ", ".join(f"{c} array<bigint>" for c in _TABLE[:4]) + ", total long, n long"
    passed = wide.groupBy("run", "_part").applyInArrow(pass_through, f"run {kind}, _part int, {tables}")
    opened = passed.groupBy("run").applyInArrow(follow, f"run {kind}, _part int, open_bytes long, open_slots long, open_block long")
    filled = with_carry(cut, opened.withColumnsRenamed({"run": "_k0", "_part": "_kpart"}), ["run"])
    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("run", *by)) + ", bytes int, block_no long, slot int"
    return filled.groupBy("run", "_part").applyInArrow(fill, schema).withColumnsRenamed({"run": run, **by})


_TABLE = ["room", "used", "slots", "blocks", "total", "n"]


def fill_with_splits(entries: DataFrame, run: str, order: str, size: Column, capacity: int = CAPACITY) -> DataFrame:
    """Blocks filled as :func:`fill_in_order` does, but an entry longer than a block's payload begins in what is left of
    the current block: ``run, order, piece, flag, start, bytes, block_no, slot``.

    Its first piece fills that block, the following ones blocks of their own, and the last one begins a block that is
    filled on. Where every piece falls depends on all entries before it, so a run is one task, on sizes alone.
    """
    rows = entries.select(F.col(run).alias("run"), F.col(order).alias("ord"), size.cast("long").alias("bytes")).filter("bytes IS NOT NULL")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("ord")
        block, slot, used, out = 0, 0, 0, []
        for i, n in enumerate(table.column("bytes").to_pylist()):
            left = capacity - used - ENTRY_BYTES
            if n > MAX_PAYLOAD:
                parts = pages.cut(n, left if slot and left > 0 else MAX_PAYLOAD)
            else:
                parts = [(0, n, pages.COMPLETE)]
            for k, (start, end, flag) in enumerate(parts):
                if slot and used + end - start + ENTRY_BYTES > capacity:
                    block, slot, used = block + 1, 0, 0
                out.append((i, k, flag, start, end - start, block, slot))
                slot, used = slot + 1, used + end - start + ENTRY_BYTES
        at, *cols = (pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7))
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        names = ["run", "ord", "piece", "flag", "start", "bytes", "block_no", "slot"]
        yield from pa.Table.from_arrays([*(table.column(c).take(at) for c in ("run", "ord")), *(c.cast(t) for c, t in zip(cols, types))], names=names).to_batches()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("run", "ord"))
    schema = f"{kinds}, piece int, flag int, start long, bytes int, block_no long, slot int"
    return rows.groupBy("run").applyInArrow(fold, schema).withColumnsRenamed({"run": run, "ord": order})


def entries_of(blocks: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id_cols, slot, payload`` in the order of slots; null entries have no row."""
    return blocks.select(*id_cols, F.posexplode("entries").alias("slot", "payload")).filter("payload IS NOT NULL")


def entry_at(blocks: DataFrame, id_cols: list[str], slot: int) -> DataFrame:
    """``id_cols, payload`` of one slot of every block that has it."""
    return blocks.filter(F.size("entries") > slot).select(*id_cols, F.element_at("entries", slot + 1).alias("payload"))


def _payload_bytes() -> Column:
    sizes = F.transform("entries", lambda e: F.octet_length(e))
    return F.aggregate(F.filter(sizes, lambda n: n.isNotNull()), F.lit(0), lambda a, n: a + n)


def block_stats(blocks: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id_cols, entries_held, bytes, remaining, is_empty, is_full, count_ok``.

    ``bytes`` counts the block's count, offsets, flags and payloads. A full block takes not even an
    empty entry; a block of more than 4096 bytes has negative room. ``count_ok`` says whether the
    stored ``num_entries`` is right, null if it is null.
    """
    n = F.size(F.filter(F.coalesce("entries", F.array().cast("array<binary>")), lambda e: e.isNotNull()))
    used = F.lit(COUNT_BYTES) + n * ENTRY_BYTES + F.coalesce(_payload_bytes(), F.lit(0))
    return blocks.select(
        *id_cols,
        n.alias("entries_held"),
        used.alias("bytes"),
        (BLOCK_BYTES - used).alias("remaining"),
        (n == 0).alias("is_empty"),
        (used + ENTRY_BYTES - COUNT_BYTES > CAPACITY).alias("is_full"),
        (F.col("num_entries") == n).alias("count_ok"),
    )


def end_offsets(blocks: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id_cols, offsets, stored_ok``: the end offsets that the entries have (flag byte included), and
    whether the stored ones agree, null if they are null. Null entries take no place."""
    sizes = F.filter(F.transform("entries", lambda e: F.octet_length(e) + FLAG_BYTES), lambda n: n.isNotNull())
    # one pass that appends the next end
    nothing = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("ends"))
    step = lambda a, n: F.struct((a["end"] + n).alias("end"), F.concat(a["ends"], F.array((a["end"] + n).cast("string"))).alias("ends"))
    ends = F.aggregate(sizes, nothing, step, lambda a: a["ends"]).cast("array<int>")
    return blocks.select(*id_cols, ends.alias("_e"), F.col("offsets").alias("_o")).select(*id_cols, F.col("_e").alias("offsets"), (F.col("_e") == F.col("_o")).alias("stored_ok"))


def encode_pages(blocks: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id_cols, page``: every block in its byte form; ``flags`` are 0 where the table has none."""
    n = len(id_cols)
    flags = F.col("flags") if "flags" in blocks.columns else F.transform("entries", lambda e: F.lit(0))
    rows = blocks.select(*id_cols, F.filter("entries", lambda e: e.isNotNull()).alias("_entries"), flags.alias("_flags"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if e is None else pages.page(f or [0] * len(e), e) for e, f in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(raw, pa.binary())], names=[*id_cols, "page"])

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in id_cols)
    return rows.mapInArrow(run, f"{ids}, page binary")


def lay_out_pages(blocks: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id_cols, page_no, page``: every block in its byte form, one of more than 4096 bytes in several pages.

    Entries go in order, into the current page while they fit; those longer than a page's payload in
    pieces. Null entries take no place, and a block without entries is one empty page; null ``entries`` give none.
    """
    n = len(id_cols)
    rows = blocks.filter("entries IS NOT NULL").select(*id_cols, F.filter("entries", lambda e: e.isNotNull()).alias("_entries"))

    def laid_out(entries: list[bytes]) -> list[bytes]:
        flags, payloads, used, out = [], [], 0, []
        for e in entries:
            for start, end, flag in pages.cut(len(e)):
                if payloads and used + end - start + ENTRY_BYTES > pages.ROOM:
                    out.append(pages.page(flags, payloads))
                    flags, payloads, used = [], [], 0
                flags.append(flag)
                payloads.append(e[start:end])
                used += end - start + ENTRY_BYTES
        return [*out, pages.page(flags, payloads)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [laid_out(e) for e in b.column(n).to_pylist()]
            at = pa.array([i for i, made in enumerate(raw) for _ in made], pa.int64())
            numbers = pa.array([k for made in raw for k in range(len(made))], pa.int32())
            flat = pa.array([p for made in raw for p in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), numbers, flat], names=[*id_cols, "page_no", "page"])

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in id_cols)
    return rows.mapInArrow(run, f"{ids}, page_no int, page binary")


def entries_of_pages(raw: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id_cols, slot, payload``: the entries that :func:`lay_out_pages` laid out, numbered in order, their pieces joined."""
    found = decode_pages(raw, [*id_cols, "page_no"]).filter("slot IS NOT NULL").withColumn("piece", F.col("page_no").cast("long") * BLOCK_BYTES + F.col("slot"))
    begun = F.count_if(F.col("flag").isin(pages.COMPLETE, pages.START)).over(Window.partitionBy(*id_cols).orderBy("piece"))
    parts = found.withColumn("slot", (begun - 1).cast("int"))
    return joined_chunks(parts, [*id_cols, "slot"]).withColumnRenamed("value", "payload")


def decode_pages(raw: DataFrame, id_cols: list[str], page: str = "page") -> DataFrame:
    """``id_cols, slot, flag, payload`` of every entry of raw blocks; a block that cannot be read gives one
    row with null slot, flag and payload."""
    n = len(id_cols)
    rows = raw.select(*id_cols, F.col(page).alias("_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, slot, flag, payload = [], [], [], []
            for i, p in enumerate(b.column(n).to_pylist()):
                try:
                    found = list(enumerate(pages.read_page(p or b"")))
                except CorruptBlock:
                    found = [(None, (None, None))]
                for s, (f, e) in found:
                    at.append(i)
                    slot.append(s)
                    flag.append(f)
                    payload.append(e)
            ids = [b.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(slot, pa.int32()), pa.array(flag, pa.int32()), pa.array(payload, pa.binary())], names=[*id_cols, "slot", "flag", "payload"])

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in id_cols)
    return rows.mapInArrow(run, f"{ids}, slot int, flag int, payload binary")
