import random

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import InvalidRow
from palimpsest.functions import numbering
from palimpsest.functions.bounds import Bound, between
from palimpsest.model import COLUMNS, LOG, conform, empty_log
from palimpsest.operators import merge, reads

KEYS = [b"", b"a", b"ab", b"a\xff", b"b", b"\x80", b"\xff\xff"]
SPACES = [0, 1, 255, 256, 300]


def sample(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        gone = rng.random() < 0.15
        value = None if gone else bytearray(rng.choice([b"", b"x", b"yy"]))
        rows.append((rng.choice(SPACES), bytearray(rng.choice(KEYS)), rng.choice([1, 2, 255, 256, 1_700_000_000_000_000_001 + rng.randrange(3)]), value, gone, seq, rng.randrange(3)))
    return rows


def order(r):
    return (r[0], bytes(r[1]), -r[2], -r[6], -r[5])


@pytest.fixture(scope="module")
def rows():
    return sample(1)


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, LOG).repartition(5).cache()


def tuples(df):
    return [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()]


def test_merge_keeps_all_versions_in_the_logical_order(log, rows):
    got = [(r[0], r[1], r[2], r[5], r[6]) for r in tuples(merge.merge(log))]
    assert got == [(r[0], bytes(r[1]), r[2], r[5], r[6]) for r in sorted(rows, key=order)]


@pytest.fixture
def partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_positions_count_on_across_partitions(log, rows, partitions):
    for n in (1, 3, 16):
        partitions(n)
        got = sorted((r["pos"], r["seq"]) for r in merge.merge_positions(log).collect())
        assert got == list(enumerate([r[5] for r in sorted(rows, key=order)], 1))


def test_positions_do_not_depend_on_what_is_read_of_them(spark, partitions):
    """Pruned columns, filters, limits and joins of a use leave both readings of the shuffle the same."""
    partitions(7)
    rows = spark.range(0, 5000, 1, 5).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").cast("string").alias("v"), F.lit("x" * 50).alias("w"))
    want = {k: n for n, k in enumerate(sorted(r["k"] for r in rows.collect()))}
    placed = numbering.with_position(rows, [F.col("k")], "pos", 0)
    uses = [placed, placed.select("pos", "k"), placed.filter("k % 3 = 1").select("k", "pos"), placed.filter("pos > 17 AND v IS NOT NULL").select("k", "pos"), placed.limit(9),
            placed.join(spark.range(0, 5003, 11).withColumnRenamed("id", "k"), "k").hint("shuffle_hash").select("k", "pos"), placed.groupBy("k").agg(F.max("pos").alias("pos"))]
    for use in uses:
        picked = use.select("k", "pos")
        got = picked.collect()
        assert got and all(want[r["k"]] == r["pos"] for r in got)
        assert "ReusedExchange" in picked._jdf.queryExecution().executedPlan().toString()


def test_neighbouring_values_beside_an_outlier_spread(spark, partitions):
    partitions(8)
    rows = spark.range(0, 100_000, 1, 4).select(F.when(F.col("id") == 0, 2**62).otherwise(F.col("id")).alias("at"))
    sizes = [r["count"] for r in numbering.ranged(rows, [F.col("at")]).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 40_000


def test_latest_is_the_largest_time_then_arrival(log, rows):
    best = {}
    for r in rows:
        k = (r[0], bytes(r[1]))
        if k not in best or (r[2], r[5]) > (best[k][2], best[k][5]):
            best[k] = r
    assert {(r["ns"], bytes(r["key"])): r["seq"] for r in reads.latest(log).collect()} == {k: r[5] for k, r in best.items()}
    live = {(r["ns"], bytes(r["key"])) for r in reads.live(log).collect()}
    assert live == {k for k, r in best.items() if not r[4]}


def test_latest_by_arrival(log, rows):
    got = {(r["ns"], bytes(r["key"])): r["seq"] for r in reads.latest(log, by="arrival").collect()}
    assert got == {(r[0], bytes(r[1])): r[5] for r in rows}


def test_as_of_looks_at_no_later_version(log, rows):
    got = {(r["ns"], bytes(r["key"])): r["ts"] for r in reads.as_of(log, 256, include_deleted=True).collect()}
    want = {}
    for r in rows:
        if r[2] <= 256:
            want[(r[0], bytes(r[1]))] = max(want.get((r[0], bytes(r[1])), 0), r[2])
    assert got == want


def place(ns, key, ts):
    return (ns, key, -float("inf") if ts is None else -ts)


def test_every_kind_of_bound(log, rows):
    rng = random.Random(2)
    points = [None] + [Bound(rng.choice(SPACES), rng.choice(KEYS), rng.choice([None, 0, 1, 2, 256]), rng.random() < 0.5) for _ in range(12)]
    points += [Bound(r[0], bytes(r[1]), r[2], i) for r in rows[:2] for i in (True, False)]

    def inside(r, lo, hi):
        at = place(r[0], bytes(r[1]), r[2])
        if lo is not None and (at < place(lo.ns, lo.key, lo.ts) or (at == place(lo.ns, lo.key, lo.ts) and not lo.inclusive)):
            return False
        return not (hi is not None and (at > place(hi.ns, hi.key, hi.ts) or (at == place(hi.ns, hi.key, hi.ts) and not hi.inclusive)))

    pairs = [(rng.choice(points), rng.choice(points)) for _ in range(25)]
    found = log.select("seq", *(between(lo, hi).alias(f"p{i}") for i, (lo, hi) in enumerate(pairs))).collect()
    by_seq = {r[5]: r for r in rows}
    for r in found:
        for i, (lo, hi) in enumerate(pairs):
            assert r[f"p{i}"] == inside(by_seq[r["seq"]], lo, hi), (lo, hi, by_seq[r["seq"]])


def test_bounds_reach_the_scan(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    plan = reads.scan(spark.read.parquet(str(tmp_path / "log")), Bound(1, b"a"), Bound(255, b"b"), ordered=False)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ns,1)" in text and "LessThanOrEqual(ns,255)" in text


def test_history_equals_a_walk_over_each_key(log, rows, partitions):
    want = {}
    for key in {(r[0], bytes(r[1])) for r in rows}:
        own = sorted((r for r in rows if (r[0], bytes(r[1])) == key), key=lambda r: (-r[2], -r[5]))
        for n, r in enumerate(own):
            older = own[n + 1] if n + 1 < len(own) else None
            want[r[5]] = (n + 1, None if older is None else r[2] - older[2], (older[3] if older else None) != r[3])
    for n in (1, 5, 16):
        partitions(n)
        assert {r["seq"]: (r["version"], r["age_ns"], r["changed"]) for r in reads.history(log).collect()} == want


def test_history_numbers_versions_from_the_newest(log):
    rows = [r for r in reads.history(log).collect() if r["version"] == 1]
    latest = {(r["ns"], bytes(r["key"])): r["seq"] for r in reads.latest(log).collect()}
    assert {(r["ns"], bytes(r["key"])): r["seq"] for r in rows} == latest


def test_multi_get_takes_null_namespace_as_0_and_skips_missing_keys(spark, log):
    keys = spark.createDataFrame([(None, bytearray(b"a")), (0, bytearray(b"a")), (0, bytearray(b"none")), (256, None)], "ns long, key binary")
    got = reads.multi_get(log, keys).collect()
    assert {(r["ns"], bytes(r["key"])) for r in got} <= {(0, b"a")} and len(got) <= 1


def test_empty_log(spark):
    none = empty_log(spark)
    assert reads.latest(none).count() == reads.history(none).count() == merge.merge(none).count() == merge.compact(none).count() == 0
    assert merge.run_stats(none).count() == reads.version_counts(none).count() == 0
    assert merge.runs([], spark).count() == 0


def test_conform_defaults_and_validity(spark):
    rows = spark.createDataFrame([(bytearray(b"k"), 5, "extra"), (None, 5, ""), (bytearray(b"k"), 0, ""), (bytearray(b"k"), None, "")], "key binary, ts long, note string")
    got = conform(rows)
    assert got.columns == COLUMNS and [(r["ns"], r["ts"], r["is_delete"]) for r in got.collect()] == [(0, 5, False)]
    with pytest.raises(InvalidRow):
        conform(rows, strict=True)


# Runs of the merge: (ns, key, ts) each, and what comes out.
MERGES = {
    "no rows": ([[], []], []),
    "one run": ([[(0, b"key1", 1), (0, b"key2", 2)]], [(0, b"key1", 1), (0, b"key2", 2)]),
    "versions": ([[(0, b"k", 3)], [(0, b"k", 2)], [(0, b"k", 1)]], [(0, b"k", 3), (0, b"k", 2), (0, b"k", 1)]),
    "namespaces": ([[(2, b"k", 1)], [(1, b"k", 1)]], [(1, b"k", 1), (2, b"k", 1)]),
    "three runs": (
        [[(1, b"k", t), (2, b"k", t)] for t in (3, 1, 2)],
        [(n, b"k", t) for n in (1, 2) for t in (3, 2, 1)],
    ),
    "uneven": ([[(0, b"a", 1)], [(0, b"b", 1)], []], [(0, b"a", 1), (0, b"b", 1)]),
    "interleaved": (
        [[(0, b"key1", 3), (0, b"key2", 1)], [(0, b"key1", 2), (0, b"key2", 2)]],
        [(0, b"key1", 3), (0, b"key1", 2), (0, b"key2", 2), (0, b"key2", 1)],
    ),
}


@pytest.mark.parametrize("name", MERGES)
def test_runs_merge(spark, name):
    runs, want = MERGES[name]
    parts = [spark.createDataFrame([(n, bytearray(k), t, bytearray(b"v"), False, i, 0) for i, (n, k, t) in enumerate(r)], LOG) for r in runs]
    assert [(r["ns"], bytes(r["key"]), r["ts"]) for r in merge.merge(merge.runs(parts, spark)).collect()] == want


def test_compaction_keeps_or_drops_tombstones(spark):
    rows = [(0, bytearray(b"a"), 1, bytearray(b"v"), False, 1, 0), (0, bytearray(b"a"), 2, None, True, 2, 1), (0, bytearray(b"b"), 1, bytearray(b""), False, 3, 0), (0, bytearray(b"p"), 0, bytearray(b"x"), False, 4, 0)]
    log = spark.createDataFrame(rows, LOG)
    assert {bytes(r["key"]) for r in merge.compact(log).collect()} == {b"a", b"b"}
    assert {bytes(r["key"]) for r in merge.compact(log, drop_tombstones=True).collect()} == {b"b"}
