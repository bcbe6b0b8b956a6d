import random

import pytest
from pyspark.sql import functions as F

from palimpsest import errors
from palimpsest.clock import HybridClock
from palimpsest.extent_store import CompactionConfig, ExtentStore
from palimpsest.operators import journal
from palimpsest.store import Store, StoreOptions
from palimpsest.streaming import ingest


def test_puts_deletes_and_reopening(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put(b"a", b"1")
    s.put(b"a", b"2")
    s.put_ns(300, b"a", b"other")
    s.put(b"empty", b"")
    s.delete(b"missing")
    assert (s.get(b"a"), s.get_ns(300, b"a"), s.get(b"empty"), s.get(b"missing"), s.get(b"never")) == (b"2", b"other", b"", None, None)
    s.close()
    with pytest.raises(errors.EngineError):
        s.put(b"x", b"y")
    again = Store(spark, str(tmp_path))
    assert again.get(b"a") == b"2"
    again.delete(b"a")
    assert again.get(b"a") is None and again.get(b"a", raw=True) == b""
    again.put(b"a", b"3")
    again.sync()
    assert len(again.runs) == 2 and again.get(b"a") == b"3"
    again.compact()
    assert len(again.runs) == 1 and again.log().count() == 3
    assert Store(spark, str(tmp_path)).get(b"a") == b"3"


def test_version_times_go_on_after_reopening(spark, tmp_path):
    s = Store(spark, str(tmp_path), StoreOptions(clock=HybridClock(0, lambda: 10**18)))
    last = s.put(b"a", b"1")
    s.close()
    again = Store(spark, str(tmp_path), StoreOptions(clock=HybridClock(0, lambda: 5)))
    assert again.time() > last


def test_batches_are_whole_or_partial(spark, tmp_path):
    s = Store(spark, str(tmp_path), StoreOptions(run_bytes=300, rotate=False))
    ops = [("put", None, b"k%d" % i, 5 + i, b"v" * 20) for i in range(3)]
    with pytest.raises(errors.CapacityExceeded):
        s.batch(ops)
    assert s.run_bytes == 0
    assert s.batch(ops, partial=True) == 2
    for bad in (("put", 0, b"k", 0, b""), ("put_ns", -1, b"k", 1, b""), ("put", 0, None, 1, b""), ("merge", 0, b"k", 1, b"")):
        with pytest.raises(errors.InvalidRow):
            s.batch([bad])
    assert s.get(b"k1") == b"v" * 20 and s.get(b"k2") is None


def test_freezing_and_new_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put(b"a", b"1")
    s.freeze()
    with pytest.raises(errors.RunFrozen):
        s.put(b"b", b"1")
    assert s.new_run() == 1
    s.put(b"b", b"2")
    assert sorted(r["src"] for r in s.log().collect()) == [0, 1]


def test_second_writer_fails(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.put(b"k", b"a")
    a.sync()
    b.put(b"k", b"b")
    with pytest.raises(errors.StaleManifest):
        b.sync()
    assert Store(spark, str(tmp_path)).get(b"k") == b"a"


def test_tables_are_written_once_per_batch_id(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    ops = spark.range(100).select(F.lit("put_ns").alias("op"), (F.col("id") % 3).alias("ns"), F.col("id").cast("string").cast("binary").alias("key"), F.lit("v").cast("binary").alias("value"))
    assert s.write_table(ops, batch_id="b1") and not s.write_table(ops, batch_id="b1")
    log = s.log()
    assert log.count() == 100 and log.select("ts").distinct().count() == 100 and log.select("seq").distinct().count() == 100


@pytest.mark.parametrize("seed", range(2))
def test_store_equals_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    s, model = Store(spark, str(tmp_path), StoreOptions(max_runs=3)), {}
    for _ in range(6):
        ops = []
        for _ in range(20):
            ns, key = rng.choice([0, 256]), rng.choice([b"a", b"ab", b"", b"\xff"])
            if rng.random() < 0.3:
                ops.append(("delete_ns", ns, key, s.time(), None))
                model.pop((ns, key), None)
            else:
                value = rng.randbytes(rng.randrange(4))
                ops.append(("put_ns", ns, key, s.time(), value))
                model[(ns, key)] = value
        s.batch(ops)
        s.sync()
    assert {(r["ns"], bytes(r["key"])): bytes(r["value"]) for r in s.live().collect()} == model
    assert len(s.runs) <= 3


def test_history_survives_any_number_of_syncs(spark, tmp_path):
    few, many = Store(spark, str(tmp_path / "few"), StoreOptions(max_runs=4)), Store(spark, str(tmp_path / "many"), StoreOptions(max_runs=1000))
    for n in range(13):
        for s in (few, many):
            s.batch([("put_ns", 1, b"k", 10 + n, b"v%d" % n), ("delete_ns" if n % 2 else "put_ns", 1, b"d", 10 + n, None if n % 2 else b"w")])
            s.sync()
    assert len(few.runs) < 4 and len(many.runs) == 13
    rows = lambda s: sorted((r["ts"], bytes(r["key"]), r["value"], r["is_delete"], r["seq"]) for r in s.log().collect())
    assert rows(few) == rows(many) and len(rows(few)) == 26
    for ts in (9, 10, 15, 22):
        state = lambda s: sorted((bytes(r["key"]), r["value"]) for r in s.as_of(ts).collect())  # noqa: B023, E731
        assert state(few) == state(many)
    assert sum(r["rows"] for r in few.runs) == 26
    again = Store(spark, str(tmp_path / "few"))
    assert bytes(again.as_of(10).filter("key = X'6B'").first()["value"]) == b"v0"


def test_history_is_dropped_up_to_a_horizon(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.batch([("put_ns", 1, b"k", 10, b"a"), ("put_ns", 1, b"k", 20, b"b"), ("put_ns", 1, b"k", 30, b"c"), ("put_ns", 1, b"d", 10, b"x"), ("delete_ns", 1, b"d", 15, None)])
    s.compact(horizon=25)
    assert sorted((bytes(r["key"]), r["ts"]) for r in s.log().collect()) == [(b"k", 20), (b"k", 30)]
    assert bytes(s.as_of(25).first()["value"]) == b"b"
    s.compact(keep_history=True)
    assert s.log().count() == 2
    s.compact()
    assert [r["ts"] for r in s.log().collect()] == [30]


def test_readers_keep_the_files_their_plans_name(spark, tmp_path):
    s = Store(spark, str(tmp_path), StoreOptions(grace_seconds=1000))
    for n in range(3):
        s.put(b"k", b"%d" % n)
        s.sync()
    plan = s.log()
    s.compact()
    assert plan.count() == 3 and s.log().count() == 1
    s.options.grace_seconds = 0
    s.put(b"k", b"z")
    s.compact()
    assert len([p for p in (tmp_path / "runs").iterdir() if not p.name.startswith(".")]) == 1


def test_a_torn_state_is_passed_over(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put(b"k", b"1")
    s.sync()
    last = sorted((tmp_path / "manifest").glob("*.json"))[-1]
    torn = last.with_name(f"{int(last.stem) + 1:012d}.json")
    torn.write_text('{"runs": [')
    again = Store(spark, str(tmp_path))
    assert again.get(b"k") == b"1"
    again.put(b"k", b"2")
    again.sync()
    assert Store(spark, str(tmp_path)).get(b"k") == b"2" and not list((tmp_path / "manifest").glob("*.tmp"))


def test_of_a_stream_the_last_batch_number_is_kept(spark, tmp_path):
    s = Store(spark, str(tmp_path), StoreOptions(max_runs=3))
    row = lambda n: spark.createDataFrame([("put", 0, bytearray(b"k"), n + 1, bytearray(b"v"))], "op string, ns long, key binary, ts long, value binary")
    assert [s.write_table(row(n), f"in-{n}") for n in (0, 1, 1, 2, 0, 3)] == [True, True, False, True, False, True]
    assert s._state["batches"] == {"in": 3} and s.log().count() == 4 and len(s.runs) < 3


SIZE = 1 << 22


def test_extents_allocate_and_free(spark, tmp_path):
    x = ExtentStore(spark, str(tmp_path), SIZE)
    ids = [x.create(1024) for _ in range(3)]
    assert ids == [0, 1, 2]
    x.delete(1)
    x.delete(77)
    assert len(x._free) == 2
    assert x.create(512) == 3
    with pytest.raises(errors.StorageExhausted):
        x.create(SIZE)
    with pytest.raises(errors.FragmentationLimit):
        x.create(x.total_free())
    h = x.open(0)
    for fails, error in ((lambda: x.open(0), errors.AlreadyOpen), (lambda: x.open(9), errors.ExtentNotFound), (lambda: x.delete(0), errors.StillOpen), (lambda: h.write_at(1000, b"x" * 25), errors.WriteOutOfBounds), (lambda: h.read_at(0, 1025), errors.ReadOutOfBounds)):
        with pytest.raises(error):
            fails()
    h.close()
    with pytest.raises(errors.AlreadyClosed):
        h.read_at(0, 1)
    assert x.health().first()["space_accounting_valid"]
    with pytest.raises(errors.InsufficientSpace):
        ExtentStore(spark, str(tmp_path / "small"), 1000)
    with pytest.raises(errors.InvalidHeader):
        ExtentStore(spark, str(tmp_path / "none"))


def test_bytes_survive_reopening(spark, tmp_path):
    x = ExtentStore(spark, str(tmp_path), SIZE)
    i = x.create(20_000)
    with x.open(i) as h:
        h.write_at(4090, b"hello world")
        h.write_at(0, b"start")
        assert len(h) == 4101 and h.read_at(4088, 15) == b"\0\0hello world\0\0"
        assert len(x.dirty_ranges()) == 1
    y = ExtentStore(spark, str(tmp_path))
    with y.open(i) as h:
        assert h.read_at(0, 5) == b"start" and h.read_at(4090, 11) == b"hello world" and len(h) == 4101
    assert y.create(10) == i + 1


def test_compaction_shrinks_half_filled_extents(spark, tmp_path):
    x = ExtentStore(spark, str(tmp_path), SIZE)
    for n in range(6):
        with x.open(x.create(16_384)) as h:
            h.write_at(0, b"%d" % n * 4096)
    for n in (0, 2, 4):
        x.delete(n)
    before = x.total_free()
    assert x.maybe_compact(CompactionConfig(0.2, 1024, 5))
    assert x.total_free() > before and x.health().first()["space_accounting_valid"]
    with x.open(3) as h:
        assert h.read_at(0, 4096) == b"3" * 4096 and h.capacity == 4096
    replayed = {r["id"]: (r["range_start"], r["range_end"]) for r in journal.replay_extents(x.journal()).collect()}
    assert replayed == {e.id: (e.range_start, e.range_end) for e in x._extents.values()}
    assert not ExtentStore(spark, str(tmp_path / "b"), SIZE).maybe_compact()


def test_compaction_moves_what_it_can(spark, tmp_path):
    x = ExtentStore(spark, str(tmp_path), SIZE)
    ids = [x.create(65_536) for _ in range(3)]
    with x.open(ids[0]) as h:
        h.write_at(0, b"x" * 100)
    x.create(x.total_free())
    assert x.total_free() == 0
    assert not x.maybe_compact(CompactionConfig(0.0, 1024, 5))
    x.delete(ids[1])
    assert x.maybe_compact(CompactionConfig(0.0, 1024, 5)) and x.health().first()["space_accounting_valid"]
    assert ExtentStore(spark, str(tmp_path))._free == x._free


def test_ingest_is_idempotent_and_order_free(spark, tmp_path):
    src = tmp_path / "in"
    schema = "op string, ns long, key binary, ts long, value binary"
    rows = [("put", 0, bytearray(b"k"), 2, bytearray(b"new")), ("put", 0, bytearray(b"k"), 1, bytearray(b"old")), ("delete", 0, bytearray(b"d"), 3, None)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(src))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = ingest.ingest(spark.readStream.schema(schema).parquet(str(src)), store, str(tmp_path / "cp"), available_now=True)
        q.awaitTermination(60)
    assert store.get(b"k") == b"new" and store.get(b"d") is None and store.log().count() == 3


def test_running_views_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(0, bytearray(b"k"), t, bytearray(b"%d" % t), False, i) for i, t in enumerate((2, 5, 1))]
    df = spark.createDataFrame(rows, "ns long, key binary, ts long, value binary, is_delete boolean, seq long")
    df.withColumn("at", F.timestamp_seconds("ts")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = ingest.latest_updates(stream).writeStream.format("memory").queryName("newest").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["ts"], bytes(r["value"])) for r in spark.table("newest").collect()] == [(5, b"5")]
    q = ingest.once_per_version(stream.union(stream), "at", "1 minute").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 3


def test_caching_follows_the_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.cache()
    s.put(b"a", b"1")
    s.sync()
    s.cache()
    assert s.get(b"a") == b"1"
    s.put(b"a", b"2")
    s.sync()
    assert s.get(b"a") == b"2"
    s.close()


def test_rates_of_a_stream_per_window(spark, tmp_path):
    rows = [(1, False, s) for s in (0, 10, 70)] + [(1, True, 20), (2, False, 5), (1, False, 5000)]
    df = spark.createDataFrame(rows, "ns long, is_delete boolean, s long").select("ns", "is_delete", F.timestamp_seconds("s").alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    rates = ingest.write_rates(stream, "at", "1 minute", "10 seconds")
    q = rates.writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["ns"], r["start"].minute): (r["puts"], r["deletes"]) for r in spark.table("rates").collect() if r["start"].hour == 0}
    assert got[(1, 0)] == (2, 1) and got[(2, 0)] == (1, 0) and got[(1, 1)] == (1, 0)
