import numpy as np
import pytest

pytest.importorskip("palimpsest.llm")

from pyspark.sql import functions as F

from palimpsest.llm import seen

LOG = "seq long, ns long, key binary, h string"
IN = "in_id long, op string, ns long, key binary, first int"


def test_filters_never_miss_and_seldom_err():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 100, 30_000, 400_000):
        keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))
        seed, third, table = seen.build_filter(keys)
        assert seen.probe_filter(keys, seed, third, table).all()
        assert n < 1000 or len(table) * 8 / n < 22
        other = rng.integers(-(2**63), 2**63 - 1, 200_000, dtype=np.int64)
        wrong = seen.probe_filter(other, seed, third, table).mean()
        assert wrong < 5 * 2**-16 or n < 3


def test_seen_before(spark, monkeypatch):
    monkeypatch.setattr(seen, "PROBE_BATCH", 2)
    log = [(1, 0, b"a"), (2, None, b"b \0"), (3, 5, b"c"), (3, 5, b"c"), (None, 5, b"late"), (9, 5, None), (10, 7, b""), (11, 300, b"\xff\x00\x20")]
    put = [
        (1, 0, b"a\0\0"), (2, None, b"a"), (3, 0, b"b"), (4, 5, b"b"), (5, 5, b"b"), (6, 5, b"late"), (7, 5, None), (8, 5, None), (9, 7, b" \0 "), (10, 300, b"\xff"),
        (11, 300, b"\xfe"), (12, 1, b"x"), (12, 1, b"x"), (13, 1, b"x "),
    ]
    l = spark.createDataFrame([(s, n, None if k is None else bytearray(k), "clash") for s, n, k in log], LOG)
    p = spark.createDataFrame([(i, "put", n, None if k is None else bytearray(k), 0) for i, n, k in put], IN)
    assert sorted(r[0] for r in seen.seen_before(p, l).collect()) == [1, 2, 3, 5, 6, 9, 10, 13]
    assert sorted(r[0] for r in seen.seen_before(p, l.limit(0)).collect()) == [2, 5, 13]
    assert seen.seen_before(p.limit(0), l).count() == 0


def test_a_hot_key_and_many_generations(spark):
    log = spark.range(3000).select(F.col("id").alias("seq"), F.lit(1).cast("long").alias("ns"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).cast("binary").alias("key"))
    put = spark.range(2000).select(F.col("id").alias("in_id"), F.lit(1).cast("long").alias("ns"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") * 2).cast("string")).cast("binary").alias("key"))
    known = {str(i) for i in range(3000) if i % 3} | {"hot"}
    want = [i for i in range(2000) if ("hot" if i % 3 == 0 else str(2 * i)) in known]
    assert sorted(r[0] for r in seen.seen_before(put, log).collect()) == want
    sealed = seen.SealedBatches(log, generations=4, filter_keys=100)
    assert sealed.shards == 8 and sealed.filters.count() <= 32


def test_error_report(spark):
    log = spark.range(4000).select(F.col("id").alias("seq"), F.lit(0).cast("long").alias("ns"), F.col("id").cast("string").cast("binary").alias("key"))
    put = spark.range(2000, 12_000).select(F.col("id").alias("in_id"), F.lit(0).cast("long").alias("ns"), F.col("id").cast("string").cast("binary").alias("key"))
    rows = {r["generation"]: r for r in seen.error_report(put, log, bits=4).collect()}
    assert set(rows) == {-1, *range(seen.GENERATIONS)}
    for g, r in rows.items():
        lacking = r["probes"] - (r["hits"] - r["wrong_hits"])
        assert 0.7 < r["wrong_hits"] / lacking / r["expected_rate"] < 1.3, (g, r)
    assert all(r["missed"] == 0 and 0.7 < r["measured_rate"] / r["expected_rate"] < 1.3 for r in rows.values())
    totals = seen.error_totals(seen.error_report(put, log)).first()
    assert tuple(totals) == (10_000, 2000, 0, True)
    assert rows[-1]["hits"] - rows[-1]["wrong_hits"] == 2000
    assert rows[-1]["expected_rate"] == pytest.approx(1 - (1 - 1 / 16) ** 8)


def keyed(spark, lo, hi, name="seq"):
    return spark.range(lo, hi).select(F.col("id").alias(name), F.lit(0).cast("long").alias("ns"), F.col("id").cast("string").cast("binary").alias("key"))


def test_filters_are_saved_loaded_and_appended_and_the_log_is_not_read(spark, tmp_path):
    path = str(tmp_path / "filters")
    seen.SealedBatches(keyed(spark, 0, 1000), generations=3, filter_keys=100).save(path)
    sealed = seen.SealedBatches.load(spark, path).append(keyed(spark, 5000, 5500).drop("seq"), path)
    assert sealed.shards == 4 and {r["gen"] for r in sealed.filters.select("gen").collect()} == {0, 1, 2, 3}
    put = keyed(spark, 900, 5100, "in_id")
    found = seen.seen_before(put, sealed=seen.SealedBatches.load(spark, path))
    ids = {r[0] for r in found.collect()}
    true = {*range(900, 1000), *range(5000, 5100)}
    assert true <= ids and len(ids - true) < 5
    assert "ExistingRDD" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "seq" not in plan
    with pytest.raises(ValueError):
        seen.seen_before(put)


def test_generations_are_of_about_equal_size_whatever_the_order_values(spark):
    log = keyed(spark, 0, 4000).withColumn("seq", F.when(F.col("seq") == 7, 2**60).otherwise(F.col("seq")))
    sealed = seen.SealedBatches(log)
    sizes = [r["n"] for r in sealed.filters.groupBy("gen").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) == seen.GENERATIONS and max(sizes) < 2 * min(sizes)
