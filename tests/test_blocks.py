import random

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import BlockFull, CorruptBlock, EntryTooLarge, InvalidSegmentSize
from palimpsest.functions import pages
from palimpsest.operators import blocks, segments

BLOCKS = "block_id long, segment_id long, num_entries int, offsets array<int>, entries array<binary>"


def test_pages_round_trip_and_limits():
    entries = [b"", b"abcd", b"x" * 4000]
    raw = pages.page([0, 1, 3], entries)
    assert len(raw) == 4096 and pages.read_page(raw) == [(0, b""), (1, b"abcd"), (3, b"x" * 4000)]
    assert pages.read_page(pages.page([0], [b"y" * 4090])) == [(0, b"y" * 4090)]
    assert pages.read_page(pages.page([], [])) == []
    for n in (4091, 4095, 4096):
        with pytest.raises(EntryTooLarge):
            pages.page([0], [b"z" * n])
    with pytest.raises(BlockFull):
        pages.page([0, 0], [b"z" * 4080, b"z" * 10])
    for bad in (b"", b"\xff" * 4096, b"\x01\x00\xff\x7f".ljust(4096, b"\0")):
        with pytest.raises(CorruptBlock):
            pages.read_page(bad)


def test_cut_uses_the_room_that_is_left_first():
    assert pages.cut(0) == [(0, 0, 0)] and pages.cut(4090) == [(0, 4090, 0)]
    assert pages.cut(9000) == [(0, 4090, 1), (4090, 8180, 2), (8180, 9000, 3)]
    assert pages.cut(100, first=30) == [(0, 30, 1), (30, 100, 3)]


def test_chunks_join_again(spark):
    values = {1: b"", 2: b"a" * 10, 3: bytes(range(256)) * 40, 4: b"b" * 4090, 5: None}
    df = spark.createDataFrame([(k, v and bytearray(v) if v else v, "clash") for k, v in values.items()], "id long, value binary, payload string")
    parts = blocks.chunks(df, ["id"])
    flags = {}
    for r in parts.orderBy("id", "piece").collect():
        flags.setdefault(r["id"], []).append(r["flag"])
    assert flags == {1: [0], 2: [0], 3: [1, 2, 3], 4: [0]}
    assert {r["id"]: bytes(r["value"]) for r in blocks.joined_chunks(parts, ["id"]).collect()} == {k: v for k, v in values.items() if v is not None}


def test_filling_in_order(spark):
    rng = random.Random(0)
    rows = [(run, i, rng.choice([0, 5, 300, 2000, 4090])) for run in (1, 2) for i in range(80)] + [(None, 1, 7), (1, 99, None)]
    got = blocks.fill_in_order(spark.createDataFrame(rows, "run long, i long, n int"), "run", "i", F.col("n")).collect()
    place = {(r["run"], r["i"]): (r["block_no"], r["slot"]) for r in got}
    want = {(None, 1): (0, 0)}
    for run in (1, 2):
        block, slot, used = 0, -1, 0
        for _, i, n in [r for r in rows if r[0] == run and r[2] is not None]:
            if slot >= 0 and 4096 - 2 - used < n + 4:
                block, slot, used = block + 1, -1, 0
            slot, used = slot + 1, used + n + 3
            want[(run, i)] = (block, slot)
    assert place == want


@pytest.mark.parametrize("width", [1, 2, 7, 16])
def test_filling_does_not_depend_on_the_parts(spark, width):
    """Runs that go on over many parts, with entries larger than a block too, are filled as by one writer."""
    rng = random.Random(width)
    rows = [(run, i, rng.choice([0, 1, 40, 300, 2000, 4090] if run else [0, 0, 9, 5000])) for run in (0, 1, 2) for i in range(60 if run == 2 else 900)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        df = spark.createDataFrame(rows, "run long, i long, n int").repartition(3)
        got = {(r["run"], r["i"]): (r["block_no"], r["slot"]) for r in blocks.fill_in_order(df, "run", "i", F.col("n")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    want = {}
    for run in (0, 1, 2):
        block, slot, used = 0, -1, 0
        for _, i, n in [r for r in rows if r[0] == run]:
            if slot >= 0 and used + n + 3 > 4093:
                block, slot, used = block + 1, -1, 0
            slot, used = slot + 1, used + n + 3
            want[(run, i)] = (block, slot)
    assert got == want


def test_a_long_entry_begins_in_what_is_left_of_the_block(spark):
    rows = [(1, 1, 1000), (1, 2, 9000), (1, 3, 50), (1, 4, 4000), (2, 1, 9000), (2, 2, None), (3, 1, 4090), (3, 2, 4091), (4, 1, 0), (4, 2, 4090)]
    got = blocks.fill_with_splits(spark.createDataFrame(rows, "run long, i long, n long"), "run", "i", F.col("n")).collect()
    place = {}
    for r in sorted(got):
        place.setdefault((r["run"], r["i"]), []).append((r["flag"], r["start"], r["bytes"], r["block_no"], r["slot"]))
    assert place == {
        (1, 1): [(0, 0, 1000, 0, 0)], (1, 2): [(1, 0, 3087, 0, 1), (2, 3087, 4090, 1, 0), (3, 7177, 1823, 2, 0)], (1, 3): [(0, 0, 50, 2, 1)], (1, 4): [(0, 0, 4000, 3, 0)],
        (2, 1): [(1, 0, 4090, 0, 0), (2, 4090, 4090, 1, 0), (3, 8180, 820, 2, 0)], (3, 1): [(0, 0, 4090, 0, 0)], (3, 2): [(1, 0, 4090, 1, 0), (3, 4090, 1, 2, 0)],
        (4, 1): [(0, 0, 0, 0, 0)], (4, 2): [(0, 0, 4090, 1, 0)],
    }


def test_statistics_of_odd_blocks(spark):
    rows = [(1, 1, 2, None, [bytearray(b"abcd"), bytearray(b"efgh")]), (2, 1, None, [1], [None, bytearray(b"")]), (3, 1, 0, None, None), (4, 1, 1, [4091], [bytearray(b"x" * 4090)])]
    df = spark.createDataFrame(rows, BLOCKS)
    got = {r["block_id"]: tuple(r)[1:] for r in blocks.block_stats(df, ["block_id"]).collect()}
    assert got == {1: (2, 16, 4080, False, False, True), 2: (1, 5, 4091, False, False, None), 3: (0, 2, 4094, True, False, True), 4: (1, 4095, 1, False, True, True)}
    ends = {r["block_id"]: (r["offsets"], r["stored_ok"]) for r in blocks.end_offsets(df.filter("entries is not null"), ["block_id"]).collect()}
    assert ends == {1: ([5, 10], None), 2: ([1], True), 4: ([4091], True)}
    assert blocks.entries_of(df, ["block_id"]).count() == 4
    assert blocks.entry_at(df, ["block_id"], 1).count() == 2


def test_raw_pages_of_tables(spark):
    df = spark.createDataFrame([(1, 1, 0, None, [bytearray(b"a"), None, bytearray(b"")]), (2, 1, 0, None, [])], BLOCKS)
    raw = blocks.encode_pages(df, ["block_id"]).unionByName(spark.createDataFrame([(3, bytearray(b"short")), (4, None)], "block_id long, page binary"))
    got = sorted((r["block_id"], r["slot"], r["payload"] and bytes(r["payload"])) for r in blocks.decode_pages(raw, ["block_id"]).fillna(-1, ["slot"]).collect())
    assert got == [(1, 0, b"a"), (1, 1, b""), (3, -1, None), (4, -1, None)] or got == [(1, 0, b"a"), (1, 1, bytearray()), (3, -1, None), (4, -1, None)]


def test_segments_hold_what_their_size_allows(spark):
    df = spark.createDataFrame([(s, b) for s in (1, 2) for b in range(3)], "segment_id long, block_id long")
    placed = segments.layout(df, "segment_id", "block_id", 2 * 4096)
    assert sorted((r["segment_id"], r["offset"]) for r in placed.filter("stored").collect()) == [(s, o) for s in (1, 2) for o in (0, 4096)]
    with pytest.raises(InvalidSegmentSize):
        segments.layout(df, "segment_id", "block_id", 5000)
    assert segments.read_block(placed.filter("stored"), 1, 2).count() == 0
    assert [r["block_no"] for r in segments.seek(placed, 1).collect()] == [1, 2, 1, 2]
    assert {r["segment_id"]: r["blocks_remaining"] for r in segments.remaining(placed, 1).collect()} == {1: 2, 2: 2}


def test_files_of_pages(spark, tmp_path):
    from palimpsest.sources.pagefiles import read_pages

    (tmp_path / "s1").write_bytes(pages.page([0, 0], [b"a", b""]) + pages.page([1], [b"x" * 4090]))
    (tmp_path / "s2").write_bytes(pages.page([0], [b"b"]) + b"tail")
    (tmp_path / "s3").write_bytes(b"")
    raw = read_pages(spark, str(tmp_path))
    got = blocks.decode_pages(raw, ["file", "block_no"]).collect()
    assert sorted((r["file"][-2:], r["block_no"], r["slot"] if r["slot"] is not None else -1) for r in got) == [("s1", 0, 0), ("s1", 0, 1), ("s1", 1, 0), ("s2", 0, 0), ("s2", 1, -1)]


def test_pieces_of_a_long_entry_fill_blocks_in_order(spark, tmp_path):
    from palimpsest.plans.catalog import QUERIES

    rows = [(1, 1, 3, None, [bytearray(b"a" * 9000), None, bytearray(b"b" * 100)]), (2, 1, 1, None, [bytearray(b"c" * 4090)])]
    spark.createDataFrame(rows, BLOCKS).write.parquet(f"{tmp_path}/blocks.parquet")
    got = sorted(tuple(r) for r in QUERIES["block_packing"](spark, str(tmp_path)).select("place", "piece", "bytes", "block_no", "slot").collect())
    assert got == [(65_536, 0, 4090, 0, 0), (65_536, 1, 4090, 1, 0), (65_536, 2, 820, 2, 0), (65_538, 0, 100, 2, 1), (131_072, 0, 4090, 3, 0)]


def test_full_and_overfull_blocks_come_back_from_pages(spark):
    sizes = {1: [2734, 1196, 155], 2: [4000, 0, 91, 4090, 13_000, 7], 3: [], 4: [4091]}
    df = spark.createDataFrame([(b, 1, 0, None, [None, *(bytearray([i]) * n for i, n in enumerate(ns))]) for b, ns in sizes.items()], BLOCKS)
    raw = blocks.lay_out_pages(df, ["block_id"])
    assert {r["block_id"]: r["n"] for r in raw.groupBy("block_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 7, 3: 1, 4: 2}
    assert {len(r["page"]) for r in raw.collect()} == {4096}
    got = sorted((r["block_id"], r["slot"], bytes(r["payload"])) for r in blocks.entries_of_pages(raw, ["block_id"]).collect())
    assert got == [(b, i, bytes([i]) * n) for b, ns in sizes.items() for i, n in enumerate(ns)]


def test_segments_are_read_beyond_a_writers_capacity(spark, tmp_path):
    from palimpsest.plans.catalog import QUERIES

    spark.createDataFrame([(b, 1, 0, None, []) for b in range(20)], BLOCKS).write.parquet(f"{tmp_path}/blocks.parquet")
    assert [r["block_no"] for r in QUERIES["segment_seek"](spark, str(tmp_path)).collect()] == list(range(3, 20))
    assert [tuple(r) for r in QUERIES["segment_remaining"](spark, str(tmp_path)).collect()] == [(1, 20, 17)]
