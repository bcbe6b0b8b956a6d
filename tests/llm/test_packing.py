import random

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm")

from palimpsest.functions.pages import read_page
from palimpsest.llm import packing

BLOCKS = "block_id long, segment_id long, num_entries int, offsets array<int>, entries array<binary>, part string"


def check(sizes, where, capacity):
    fill = np.bincount(where, weights=sizes)
    assert (fill <= capacity).all() and (fill > 0).all()


@pytest.mark.parametrize("seed", range(5))
def test_bins_are_valid_and_near_the_least(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [10, 60, 100, 100, 34][seed] + 1, 700)
    order = np.sort(sizes)[::-1]
    where, made = packing.sum_of_squares(order, 100)
    check(order, where, 100)
    assert packing.least_bins(sizes, 100) <= made <= packing.least_bins(sizes, 100) * 1.05 + 1


def test_both_ways_through_the_gaps_choose_alike(monkeypatch):
    rng = np.random.default_rng(9)
    for n, top in ((300, 100), (2000, 60), (50, 100)):
        sizes = rng.integers(1, top + 1, n)
        found = []
        for few in (0, 10**9):
            monkeypatch.setattr(packing, "FEW_GAPS", few)
            found.append(packing.sum_of_squares(sizes, 100))
        assert (found[0][0] == found[1][0]).all() and found[0][1] == found[1][1]


def test_bound_never_exceeds_the_best_packing():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 11, 7)
        best = min_bins(sizes.tolist(), 10)
        assert packing.least_bins(sizes, 10) <= best
        where, made = packing.best_packing(sizes, 10)
        check(sizes, where, 10)
        assert best <= made <= best + 1


def min_bins(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= sizes[i]:
                go(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("n", [5, 40, 400, 6000])
def test_packing_anew_keeps_every_item(n, monkeypatch):
    monkeypatch.setattr(packing, "WORST", 12)
    rng = np.random.default_rng(n)
    sizes = rng.integers(200, 700, n)
    where, made = packing.best_packing(sizes, 1000)
    check(sizes, where, 1000)
    assert len(where) == n and len(np.unique(where)) == made >= packing.least_bins(sizes, 1000)
    assert made <= packing.sum_of_squares(np.sort(sizes)[::-1], 1000)[1]


def brute_bound(sizes, capacity):
    bound = -(-int(sizes.sum()) // capacity)
    for small in {0, *sizes[sizes <= capacity // 2].tolist()}:
        alone, half = sizes > capacity - small, (sizes > capacity // 2) & (sizes <= capacity - small)
        rest = sizes[(sizes <= capacity // 2) & (sizes >= small)].sum()
        bound = max(bound, int(alone.sum() + half.sum() + max(0, -(-(rest - (half.sum() * capacity - sizes[half].sum())) // capacity))))
    return bound


@pytest.mark.parametrize("capacity", [10, 11, 100])
def test_bound_is_what_its_definition_says(capacity):
    rng = np.random.default_rng(capacity)
    for n in (1, 2, 5, 30, 200):
        sizes = rng.integers(1, capacity + 1, n)
        assert packing.least_bins(sizes, capacity) == brute_bound(sizes, capacity)


def test_nothing_to_pack():
    assert packing.pack([]) == []
    assert packing.sum_of_squares(np.array([], dtype=np.int64), 10)[1] == 0


def table(spark, rows):
    make = lambda e: None if e is None else [None if x is None else bytearray(x) for x in e]
    return spark.createDataFrame([(b, s, 0, None, make(e), "clash") for b, s, e in rows], BLOCKS)


def restored(packed):
    parts = {}
    for r in packed:
        assert r["num_entries"] == len(r["entries"]) == len(r["flags"]) == len(r["offsets"]) == len(r["sources"])
        assert r["offsets"] == np.cumsum([len(e) + 1 for e in r["entries"]]).tolist()
        assert r["used_bytes"] == 2 + 2 * r["num_entries"] + r["offsets"][-1] <= 4096
        for e, f, s in zip(r["entries"], r["flags"], r["sources"]):
            parts.setdefault((r["segment_id"], s["block_id"], s["slot"]), {})[s["piece"]] = (bytes(e), f)
    out = {}
    for k, p in parts.items():
        flags = [p[i][1] for i in range(len(p))]
        assert flags == ([0] if len(p) == 1 else [1, *[2] * (len(p) - 2), 3])
        assert len(p) == 1 or all(len(p[i][0]) == 4090 for i in range(len(p) - 1))
        out[k] = b"".join(p[i][0] for i in range(len(p)))
    return out


def test_round_trip(spark):
    rng = random.Random(0)
    rows = [(b, rng.choice([1, 1, 1, 2, None]), [rng.randbytes(rng.choice([0, 1, 100, 1500, 4089, 4090, 4091, 13_000])) for _ in range(rng.randrange(6))]) for b in range(60)]
    rows += [rows[0], (100, 3, None), (101, 3, []), (102, 3, [None, b""]), (103, 4, [b"same"] * 500)]
    want = {(s, b, i): x for b, s, e in rows for i, x in enumerate(e or []) if x is not None}
    packed = packing.repack(table(spark, rows))
    got = packed.collect()
    assert restored(got) == want
    pages = {(r["segment_id"], r["part"], r["block_no"]): read_page(r["page"]) for r in packing.rendered(packed).collect()}
    for r in got:
        assert pages[(r["segment_id"], r["part"], r["block_no"])] == [(f, bytes(e)) for f, e in zip(r["flags"], r["entries"])]
    report = {r["segment_id"]: r for r in packing.packing_report(packed).collect()}
    assert report[4]["entries"] == 500 and all(r["blocks"] >= r["least_blocks"] for r in report.values())
    assert packing.repack(table(spark, rows).limit(0)).count() == 0


def test_a_large_segment_is_packed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 100)
    rng = random.Random(1)
    rows = [(b, 1, [rng.randbytes(rng.randrange(300)) for _ in range(10)]) for b in range(60)]
    got = packing.repack(table(spark, rows)).collect()
    assert restored(got) == {(1, b, i): x for b, _, e in rows for i, x in enumerate(e)}
    assert {r["part"] for r in got} <= set(range(6)) and len({r["part"] for r in got}) > 3
    report = packing.packing_report(packing.repack(table(spark, rows))).first()
    assert report["blocks"] <= report["least_blocks"] + 6 and 3 < report["parts"] <= 6


def test_fifty_thousand_entries_are_one_part(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(b, 1, [bytes(rng.choice([3, 40, 90, 300, 700])) for _ in range(500)]) for b in range(100)]
    report = packing.packing_report(packing.repack(table(spark, rows))).first()
    assert report["entries"] == 50_000 and report["parts"] == 1 and report["blocks"] <= report["least_blocks"] + 5
    # cut into parts all the same, a part costs a block or two
    monkeypatch.setattr(packing, "PART_ITEMS", 20_000)
    split = packing.packing_report(packing.repack(table(spark, rows))).first()
    assert split["parts"] == 3 and split["blocks"] <= report["blocks"] + 2 * split["parts"]


def test_a_block_row_repeated_many_times_is_one(spark):
    one = table(spark, [(7, 1, [b"x" * 50, None, b"", b"y" * 9000])])
    many = one.crossJoin(spark.range(0, 3000, 1, 6)).drop("id")
    assert [(r["num_entries"], r["used_bytes"]) for r in packing.repack(many).orderBy("block_no").collect()] == [(r["num_entries"], r["used_bytes"]) for r in packing.repack(one).orderBy("block_no").collect()]


def test_a_block_is_filled_to_its_last_byte(spark):
    rows = [(0, 1, [b"a" * 2734, b"b" * 1196, b"c" * 155]), (1, 2, [b"d" * 2044] * 4), (2, 3, [b"e" * 4091])]
    packed = packing.repack(table(spark, rows))
    assert sorted((r["segment_id"], r["used_bytes"]) for r in packed.collect()) == [(1, 4096), (2, 4096), (2, 4096), (3, 6), (3, 4095)]
    assert {r["segment_id"]: r["least_blocks"] for r in packing.packing_report(packed).collect()} == {1: 1, 2: 2, 3: 2}
    full = [read_page(r["page"]) for r in packing.rendered(packed).filter("segment_id = 1").collect()]
    assert full == [[(0, b"a" * 2734), (0, b"b" * 1196), (0, b"c" * 155)]]
