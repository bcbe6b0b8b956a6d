import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.running import gaps, islands, running_sum
from palimpsest.operators import extents, journal

RANGES = "start long, end long"
META = "struct<range_start:long,range_end:long,length:long,size:long,created_at:long,modified_at:long>"
JOURNAL = f"seq long, entry_type tinyint, entry_time long, frange_id long, metadata {META}, free_ranges array<struct<range_start:long,range_end:long>>"


def union(ranges):
    out = []
    for a, b in sorted(r for r in ranges if None not in r and r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def pairs(df):
    return sorted(tuple(r) for r in df.select("start", "end").collect())


@pytest.mark.parametrize("seed", range(6))
def test_islands_and_gaps_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    ranges = [(a, a + rng.randrange(0, 40)) for a in (rng.randrange(1000) for _ in range(60))] + [(5, None), (None, 7), (9, 3)]
    df = spark.createDataFrame(ranges, RANGES)
    want = union(ranges)
    assert pairs(islands(df, "start", "end")) == want
    inside = [(max(a, 100), min(b, 900)) for a, b in want if b > 100 and a < 900]
    free = [(a, b) for a, b in zip([100, *(b for _, b in inside)], [*(a for a, _ in inside), 900]) if a < b]
    assert pairs(gaps(df, 100, 900)) == free


def test_islands_of_chains_and_of_nothing(spark):
    assert pairs(islands(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (9, 10)], RANGES), "start", "end")) == [(0, 4), (9, 10)]
    none = spark.createDataFrame([], RANGES)
    assert pairs(islands(none, "start", "end")) == []
    assert pairs(gaps(none, 10, 20)) == [(10, 20)]
    assert pairs(gaps(spark.createDataFrame([(0, 30)], RANGES), 10, 20)) == []


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_with_a_hot_key(spark, descending):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1, 5, None])) for i in rng.sample(range(10_000), 300)]
    df = running_sum(spark.createDataFrame(rows, "i long, k string, v long"), "i", F.col("v"), "total", keys=["k"], descending=descending)
    want = {}
    for k in {r[1] for r in rows}:
        total = 0
        for i, _, v in sorted((r for r in rows if r[1] == k), reverse=descending):
            total += v or 0
            want[i] = total
    assert {r["i"]: r["total"] for r in df.collect()} == want


def test_allocation_takes_the_right_end_of_the_right_most_fit(spark):
    free = spark.createDataFrame([(0, 100), (200, 260), (300, 310)], RANGES)
    taken = extents.rightmost_fit(free, 50)
    assert tuple(taken.first()) == (210, 260, 200, 260)
    assert pairs(extents.after_allocation(free, taken)) == [(0, 100), (200, 210), (300, 310)]
    exact = extents.rightmost_fit(free, 60)
    assert pairs(extents.after_allocation(free, exact)) == [(0, 100), (300, 310)]
    assert extents.rightmost_fit(free, 101).count() == 0
    assert extents.rightmost_fit(free, 50, data_start=250).count() == 0


def test_allocation_outcomes(spark):
    free = spark.createDataFrame([(0, 100), (200, 260)], RANGES)
    req = spark.createDataFrame([(1, 100), (2, 150), (3, 161), (4, None)], "id long, size long")
    got = {r["id"]: r["outcome"] for r in extents.classify_allocation(req, free).collect()}
    assert got == {1: "ok", 2: "fragmentation limit", 3: "storage exhausted", 4: None}
    none = extents.classify_allocation(req, spark.createDataFrame([], RANGES))
    assert {r["outcome"] for r in none.filter("id < 4").collect()} == {"storage exhausted"}


def test_statistics_of_no_free_space_are_0(spark):
    none = spark.createDataFrame([], RANGES)
    assert tuple(extents.fragmentation(none).first()) == (0, 0, 0, 0, 0)
    ext = spark.createDataFrame([], "id long, range_start long, range_end long, length long, size long, created_at long, modified_at long")
    assert tuple(extents.compaction_trigger(none, ext).first()) == (0.0, False)
    assert extents.health(none, ext, 0).first()["space_accounting_valid"]


def test_fragmentation_average_is_whole(spark):
    free = spark.createDataFrame([(0, 5000), (6000, 6001), (7000, 7001)], RANGES)
    assert tuple(extents.fragmentation(free).first()) == (5002, 3, 5000, 1667, 2)


def test_deleting_missing_ids_changes_nothing(spark):
    ext = spark.createDataFrame([(1, 10, 20, 0, 10, 0, 0), (2, 20, 30, 0, 10, 0, 0)], "id long, range_start long, range_end long, length long, size long, created_at long, modified_at long")
    free = spark.createDataFrame([(0, 10)], RANGES)
    left, space = extents.delete_extents(ext, free, spark.createDataFrame([(1,), (1,), (77,)], "id long"))
    assert [r["id"] for r in left.collect()] == [2] and pairs(space) == [(0, 20)]


def test_pages_of_writes(spark):
    writes = spark.createDataFrame([(0, 1), (4095, 4097), (8192, 8192), (20_000, 30_000)], RANGES)
    assert sorted(r["page"] for r in extents.dirty_pages(writes).collect()) == [0, 1, 4, 5, 6, 7]
    assert pairs(extents.consolidate_pages(extents.dirty_pages(writes))) == [(0, 8192), (16384, 32768)] == pairs(extents.write_ranges(writes))


def meta(start, n, t=0):
    return (start, start + n, 0, n, t, t)


def replay(entries):
    """The fold, entry by entry."""
    live, free, ids = {}, [], 0
    for seq, kind, at, id, m, ranges in sorted(entries):
        if kind == 1 and id is not None and m is not None:
            ids = max(ids, id + 1)
            live.setdefault(id, list(m))
        elif kind == 2 and id in live:
            free.append(tuple(live.pop(id)[:2]))
        elif kind == 3 and m is not None and id in live:
            live[id][2], live[id][5] = m[2], m[5]
        elif kind == 4 and ranges is not None:
            free = [tuple(r) for r in ranges]
    return {i: tuple(m) for i, m in live.items()}, union(free), ids


@pytest.mark.parametrize("seed", range(5))
def test_replay_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(150):
        kind = rng.choices([1, 2, 3, 4], [4, 3, 4, 0.2])[0]
        id = rng.choice([None, *range(8), 3, 3, 3])
        m = None if rng.random() < 0.2 or kind in (2, 4) else (id or 0) * 100
        m = m if m is None else (m, m + 60, rng.randrange(60), 60, seq, seq)
        rows.append((seq, kind, seq, id, m, [(a, a + 5) for a in (rng.randrange(500) for _ in range(3))] if kind == 4 else None))
    df = spark.createDataFrame(rows, JOURNAL)
    live, free, ids = replay(rows)
    got = {r["id"]: tuple(r)[1:] for r in journal.replay_extents(df).collect()}
    assert got == live
    assert pairs(journal.replay_free(df)) == free
    assert journal.next_id(df).first()[0] == ids


def test_replay_of_an_empty_journal(spark):
    df = spark.createDataFrame([], JOURNAL)
    assert journal.replay_extents(df).count() == journal.replay_free(df).count() == 0
    assert journal.next_id(df).first()[0] == 0
    assert journal.retention(df, 100).count() == 0


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_no_id_follows_the_largest(spark, ansi):
    top = 2**63 - 1
    rows = [(1, 1, 0, 5, meta(0, 5), None), (2, 1, 0, top - 1, meta(5, 5), None), (3, 1, 0, top, None, None), (4, 2, 0, top, None, None), (5, 1, 0, top, meta(9, 5), None)]
    df, was = spark.createDataFrame(rows, JOURNAL), spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        # a creation without metadata and a deletion take no id
        assert [tuple(r) for r in journal.next_id(df.filter("seq < 5")).collect()] == [(top,)]
        assert [tuple(r) for r in journal.next_id(df).collect()] == [(None,)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)
    assert journal.next_id(df).dtypes == [("next_id", "bigint")]


def test_retention_keeps_the_newest_that_fit(spark):
    rows = [(1, 1, 0, 1, meta(0, 5), None), (2, 4, 0, None, None, [(0, 1)] * 100), (3, 1, 0, 2, meta(5, 5), None), (4, 2, 0, 1, None, None)]
    got = {r["seq"]: (r["bytes"], r["kept"]) for r in journal.retention(spark.createDataFrame(rows, JOURNAL), 140).collect()}
    assert got == {1: (67, False), 2: (18 + 1 + 8 + 1600, False), 3: (67, True), 4: (19, True)}


def test_entries_as_text(spark):
    rows = [(1, 1, 5, 7, meta(0, 5), None), (2, 4, None, None, None, [(0, 1), (2, 3)]), (3, 9, 1, 1, None, [])]
    df = spark.createDataFrame(rows, JOURNAL)
    text = journal.encode_entries(df)
    back = journal.decode_entries(text)
    assert sorted(back.drop("problem").collect()) == sorted(df.collect())
    assert {r["seq"]: r["problem"] for r in back.collect()} == {1: None, 2: None, 3: "invalid entry type"}
    assert journal.decode_entries(spark.createDataFrame([("{",), (None,)], "entry string")).select("problem").distinct().collect()[0][0] == "entry too short"


def test_metadata_grow_into_the_range_beside_them(spark):
    ext = spark.createDataFrame([(i, 0, 10, 1, 10, 0, 0) for i in range(100)], "id long, range_start long, range_end long, length long, size long, created_at long, modified_at long")
    need = 16 + 64 * 100 + 16
    grown = lambda rows, n=100: tuple(extents.metadata_growth(spark.createDataFrame(rows, RANGES), ext.filter(f"id < {n}"), 50).first())
    assert grown([(50, 90)], 3) == (16 + 64 * 3 + 16, 4096, 0, "fits")
    assert grown([(50, 50 + 2 * need - 4096)]) == (need, 2 * need, 2 * need - 4096, "grows")
    assert grown([(50, 60)]) == (need, 4096, 0, "insufficient space")
    assert grown([(51, 10**9)]) == (need, 4096, 0, "no adjacent space")


def test_records_have_their_fixed_sizes(spark):
    ext = spark.createDataFrame([(7, 1, 2**40, 3, 4, 5, 6), (8, 0, 1, None, 1, 0, 0)], "id long, range_start long, range_end long, length long, size long, created_at long, modified_at long")
    raw = extents.extent_records(ext)
    assert {len(r["record"]) for r in raw.collect()} == {64}
    assert bytes(raw.filter("id = 7").first()["record"]) == b"".join(x.to_bytes(8, "little") for x in (7, 1, 2**40, 7, 3, 4, 5, 6))
    assert sorted(tuple(r) for r in extents.read_extent_records(raw).collect()) == [(1, 2**40, 7, 3, 4, 5, 6), (0, 1, 8, 0, 1, 0, 0)][::-1]
    assert tuple(extents.read_range_records(spark.createDataFrame([(bytearray(b"short"),)], "record binary")).first()) == (None, None)
    assert len(extents.range_records(spark.createDataFrame([(1, 2)], RANGES)).first()["record"]) == 16
