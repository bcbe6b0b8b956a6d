import pytest

from palimpsest.clock import HybridClock, stamp
from palimpsest.errors import CapacityExceeded
from palimpsest.functions import codecs
from palimpsest.model import LOG
from palimpsest.operators import writes
from pyspark.sql import functions as F

OPS = "op string, ns long, key binary, ts long, value binary, seq long, note string"


def test_batches_are_normalised(spark):
    ops = spark.createDataFrame(
        [
            (" PUT ", 7, bytearray(b"a"), 1, bytearray(b"x"), 1, ""),
            ("put_ns", 7, bytearray(b"b"), 2, None, 2, ""),
            ("Delete_NS", None, bytearray(b"c"), 3, bytearray(b"y"), 3, ""),
            ("delete", 9, bytearray(b"d"), 4, None, 4, ""),
            ("merge", 1, bytearray(b"e"), 5, None, 5, ""),
            (None, 1, bytearray(b"e"), 5, None, 6, ""),
            ("put", 1, None, 5, None, 7, ""),
            ("put", 1, bytearray(b"e"), 0, None, 8, ""),
            ("put_ns", -1, bytearray(b"e"), 1, None, 9, ""),
        ],
        OPS,
    )
    got = {r["seq"]: (r["ns"], bytes(r["key"]), r["value"] and bytes(r["value"]), r["is_delete"]) for r in writes.normalise_batch(ops).collect()}
    assert got == {1: (0, b"a", b"x", False), 2: (7, b"b", None, False), 3: (0, b"c", None, True), 4: (0, b"d", None, True)}
    assert {r["seq"]: r["reason"] for r in writes.rejected_operations(ops).collect()} == {5: "operation", 6: "operation", 7: "key", 8: "version time", 9: "namespace"}


def row(ns, key, ts, value, seq, src=0, gone=False):
    return (ns, bytearray(key), ts, None if value is None else bytearray(value), gone, seq, src)


def test_exact_versions_within_and_across_runs(spark):
    log = spark.createDataFrame([row(0, b"a", 1, b"1", 1), row(0, b"a", 1, b"2", 2), row(0, b"a", 1, b"3", 3, 1)], LOG)
    assert sorted(bytes(r["value"]) for r in writes.exact_versions(log).collect()) == [b"2", b"3"]
    assert [bytes(r["value"]) for r in writes.exact_versions(log, per_run=False).collect()] == [b"3"]


def test_admission_stops_at_the_first_row_that_does_not_fit(spark):
    size = 3 * (24 + 1) + 8 + 4 + 16
    log = spark.createDataFrame([row(0, b"a", i, b"abcd", i) for i in (1, 2, 3)], LOG)
    assert [r["admitted"] for r in writes.admission(log, 2 * size).orderBy("seq").collect()] == [True, True, False]
    assert writes.admit(log, 2 * size, partial=True).count() == 2
    with pytest.raises(CapacityExceeded):
        writes.admit(log, 2 * size)
    assert writes.admit(log, 3 * size).count() == 3
    assert writes.run_sizes(log).first()["bytes"] == 3 * size


def test_clock_never_repeats_nor_goes_back():
    wall = iter([100, 50, 50, 200])
    c = HybridClock(0, lambda: next(wall))
    assert [c.time(), c.time(), c.reserve(10), c.time()] == [100, 101, 102, 200]
    assert HybridClock(10**19, lambda: 5).time() == 10**19 + 1


def test_stamping_gives_consecutive_times(spark):
    rows = spark.range(50).select((50 - F.col("id")).alias("seq"))
    assert sorted((r["ts"], r["seq"]) for r in stamp(rows, 1000, ["seq"]).collect()) == [(999 + i, i) for i in range(1, 51)]


def test_codecs_round_trip(spark):
    rows = [(ns, bytearray(k), ts, bytearray(v)) for ns in (0, 1, 255, 256, 2**62) for k, v in ((b"", b""), (b"test", b"test-value"), (b"\x00\xff", b"\xff" * 9)) for ts in (1, 256, 1_700_000_000_000_000_001)]
    df = spark.createDataFrame(rows, "ns long, key binary, ts long, value binary")
    ns, key, ts, value = (F.col(c) for c in df.columns)
    raw, stored = codecs.encode_key(ns, key, ts), codecs.store_value(ns, value)
    for r in df.select("*", raw.alias("k"), stored.alias("v"), codecs.store_key(ns, key, ts).alias("sk")).select(
        "*", codecs.decode_ns(F.col("k")).alias("ns2"), codecs.decode_key(F.col("k")).alias("key2"), codecs.decode_ts(F.col("k")).alias("ts2"),
        codecs.load_value(F.col("v")).alias("v2"), codecs.load_key(F.col("sk")).alias("key3"),
    ).collect():
        n, k, t, v = r["ns"], bytes(r["key"]), r["ts"], bytes(r["value"])
        assert bytes(r["k"]) == n.to_bytes(8, "little") + k + (2**128 - 1 - t).to_bytes(16, "little")
        assert (r["ns2"], bytes(r["key2"]), r["ts2"], bytes(r["v2"]), bytes(r["key3"])) == (n, k, t, v, k)


def test_damaged_value_is_not_loaded(spark):
    df = spark.createDataFrame([(0, bytearray(b"test-value"))], "ns long, value binary").select(codecs.store_value(F.col("ns"), F.col("value")).alias("v"))
    assert len(df.first()["v"]) == 26
    broken = df.select(F.concat(F.expr("substring(v, 1, 17)"), F.lit(bytearray(b"!!!!!!!!!"))).alias("v"))
    assert broken.select(codecs.load_value(F.col("v")).alias("x")).first()["x"] is None
