import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import index, orphans, skew
from palimpsest.model import LOG

INDEX = "row_id long, ns_offsets array<struct<ns:long,block_offset:long>>, n string"
EXTENTS = "id long, created_at long, modified_at long, deleted_at long, ref_id string"
REFS = "ref_table string, ref_key long, ref_id long, at long"


def test_heavy_namespaces(spark):
    log = spark.createDataFrame([(None, "x")] * 3 + [(0, "x")] * 2 + [(i, "x") for i in range(1, 96)], "ns long, key string")
    idx = spark.createDataFrame([(1, [(7, 0)] * 19, ""), (2, None, ""), (3, [], ""), (4, [(8, 0)], "")], INDEX)
    assert {tuple(r) for r in skew.heavy_namespaces(log, idx).collect()} == {("version_log", 0), ("segment_index", 7), ("segment_index", 8)}
    assert {tuple(r) for r in skew.heavy_namespaces(log, idx, 6).collect()} == {("segment_index", 7)}
    assert skew.heavy_namespaces(log.limit(0), idx.limit(0)).count() == 0


def test_joined_states_equal_the_join_of_rows(spark):
    left = spark.createDataFrame([(None, 1), (1, 2), (1, None), (1, 3), (2, 9)], "k long, v long")
    right = spark.createDataFrame([(None, 5), (1, 7), (1, 8), (3, 1)], "k long, w long")
    l, r = skew.key_states(left, F.col("k"), {"v": F.col("v")}), skew.key_states(right, F.col("k"), {"w": F.col("w")})
    got = {r["key"]: (r["pairs"], r["v"], r["w"]) for r in skew.joined_states(l, r, ("v",), ("w",)).collect()}
    rows = left.alias("a").join(right.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k"))).groupBy("a.k").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    assert got == {r["k"]: (r["n"], r["v"], r["w"]) for r in rows.collect()}
    outer = {r["key"]: (r["left_n"], r["right_n"], r["pairs"]) for r in skew.joined_states(l, r, how="full_outer").collect()}
    assert outer == {None: (1, 1, 1), 1: (3, 2, 6), 2: (1, 0, 0), 3: (0, 1, 0)}


def test_sums_over_joined_rows_do_not_overflow(spark):
    state = lambda n, c, v: spark.createDataFrame([(7, n, v)], f"key long, n long, {c} long").withColumn(c, F.col(c).cast("decimal(38,0)"))
    got = skew.joined_states(state(10**11, "v", 10**13), state(10**6, "w", 10**9), ("v",), ("w",)).first()
    assert (int(got["pairs"]), int(got["v"]), int(got["w"])) == (10**17, 10**19, 10**20)
    big = spark.createDataFrame([(1, 2**62)] * 4, "k long, v long")
    assert int(skew.key_states(big, F.col("k"), {"v": F.col("v")}).first()["v"]) == 2**64


def us(s):
    return int(dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def test_orphans(spark):
    parents = spark.createDataFrame(
        [(1, 100, 100, None, "clash"), (2, 100, 100, None, ""), (2, 100, 200, 300, ""), (3, None, None, None, ""), (None, 1, 1, None, ""), (20_000, 100, 100, 200, ""), (20_000, 100, 100, 200, "")],
        EXTENTS,
    )
    s = 1_000_000
    refs = spark.createDataFrame(
        [
            ("a", 1, 1, 100 * s), ("a", 2, 1, 99 * s), ("a", 3, 2, 300 * s), ("a", 4, 2, 300 * s + 1), ("a", 5, 9, us("2025-03-31T23:59:59")), ("a", 6, 9, None),
            ("a", 7, 2, None), ("b", 1, 3, 1), ("b", 2, -5, 1), ("b", 3, 20_000, 201 * s), ("b", 3, 20_000, 201 * s), ("b", 4, 2**60, 0),
        ],
        REFS,
    )
    got = sorted(tuple(r) for r in orphans.orphans(refs, parents).collect())
    assert got == sorted([
        ("a", 2, "1970-01", "created later"), ("a", 4, "1970-01", "deleted before"), ("a", 5, "2025-03", "missing"), ("a", 6, "unknown", "missing"),
        ("b", 2, "1970-01", "missing"), ("b", 3, "1970-01", "deleted before"), ("b", 3, "1970-01", "deleted before"), ("b", 4, "1970-01", "missing"),
    ])
    report = {(r["ref_table"], r["reason"]): r["orphans"] for r in orphans.orphan_report(orphans.orphans(refs, parents)).filter("period = '1970-01'").collect()}
    assert report[("b", "deleted before")] == 2
    assert orphans.orphans(refs, parents.limit(0)).count() == refs.count()
    assert orphans.orphans(refs.limit(0), parents).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_periods_are_in_utc_in_any_session_zone(spark, zone):
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stamps = ["2025-03-01 00:30:00.000001", "2025-02-28 23:59:59.999999", "1969-12-31 23:59:59.5", "2024-11-03 08:30:00"]
        rows = spark.createDataFrame([(i, 9, s) for i, s in enumerate(stamps)] + [(7, 9, None)], "handle_id long, id long, s string")
        opened = rows.select("handle_id", "id", F.col("s").cast("timestamp_ntz").alias("opened_at"))
        journal = spark.createDataFrame([(1, 1, us("2025-03-01T00:00:00") // 10**6, 9), (2, 1, us("2025-02-28T23:59:59") // 10**6, 9)], "seq long, entry_type tinyint, entry_time long, frange_id long")
        index = opened.select(F.col("handle_id").alias("row_id"), "id", F.col("opened_at").cast("timestamp_ntz").alias("written_at")).limit(0)
        refs = orphans.store_references(journal, opened, index)
        got = {(r["ref_table"], r["ref_key"]): r["period"] for r in orphans.orphans(refs, spark.createDataFrame([], EXTENTS)).collect()}
        assert got == {("open_extents", 0): "2025-03", ("open_extents", 1): "2025-02", ("open_extents", 2): "1969-12", ("open_extents", 3): "2024-11", ("open_extents", 7): "unknown", ("journal", 1): "2025-03", ("journal", 2): "2025-02"}
        at = {r["ref_key"]: r["at"] for r in refs.filter("ref_table = 'open_extents'").collect()}
        assert at[0] == us("2025-03-01T00:30:00") + 1 and at[2] == -500_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_repeated_references_spread_over_batches(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BATCH_ROWS", 10)
    refs = spark.range(500).select(F.lit("t").alias("ref_table"), F.lit(1).cast("long").alias("ref_key"), F.lit(3).cast("long").alias("ref_id"), F.lit(5).cast("long").alias("at"))
    assert orphans.orphans(refs, spark.createDataFrame([], EXTENTS)).count() == 500


def test_a_hot_range_is_probed_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BATCH_ROWS", 50)
    refs = spark.range(1000).select(F.lit("t").alias("ref_table"), F.col("id").alias("ref_key"), F.when(F.col("id") % 2 == 0, 4).otherwise(5).cast("long").alias("ref_id"), F.lit(None).cast("long").alias("at"))
    parents = spark.createDataFrame([(4, 1, 1, None, "")], EXTENTS)
    assert sorted(r["ref_key"] for r in orphans.orphans(refs, parents).collect()) == list(range(1, 1000, 2))


def test_index_lookup_and_membership(spark):
    keys = [(ns, bytearray(b"%03d" % k), 5, bytearray(b"v"), False, i, 0) for i, (ns, k) in enumerate((ns, k) for ns in (0, 3) for k in range(20))]
    log = spark.createDataFrame(keys, LOG)
    sparse = index.sparse_index(index.blocked(log, 8))
    starts = sorted((r["block_no"], r["ns"], bytes(r["key"])) for r in sparse.collect())
    assert starts == [(0, 0, b"000"), (1, 0, b"008"), (2, 0, b"016"), (3, 3, b"004"), (4, 3, b"012")]
    probes = spark.createDataFrame([(0, bytearray(b"000")), (0, bytearray(b"008")), (0, bytearray(b"0081")), (1, bytearray(b"z")), (3, bytearray(b"001")), (9, bytearray(b"a"))], "ns long, key binary")
    got = {(r["ns"], bytes(r["key"])): r["block_no"] for r in index.lookup(sparse, probes).collect()}
    assert got == {(0, b"000"): None, (0, b"008"): 0, (0, b"0081"): 1, (1, b"z"): 2, (3, b"001"): 2, (9, b"a"): 4}
    assert index.members(probes, log).count() == 3 and index.non_members(probes, log).count() == 3


def test_filters_never_miss(spark):
    from palimpsest.operators import membership

    log = spark.range(20_000).select((F.col("id") % 3).alias("ns"), F.col("id").cast("string").cast("binary").alias("key"))
    filters = membership.build(log, shards=4)
    assert filters.count() == 4
    probes = spark.range(15_000, 60_000).select((F.col("id") % 3).alias("ns"), F.col("id").cast("string").cast("binary").alias("key"))
    said = membership.may_contain(probes.unionByName(spark.createDataFrame([(1, None)], "ns long, key binary")), filters, shards=4)
    n, true = said.count(), index.members(said, log).count()
    assert true == 5000 and (n - true) / 40_000 < 0.02
    assert membership.may_contain(probes, membership.build(log.limit(0))).count() == 0


def test_index_rows_round_trip(spark):
    rows = [(1, 7, -5, 0, [0, 4096, -1], [(300, 4096), (2**62, 0)]), (2, None, None, 2**63 - 1, None, None), (3, 0, 1, None, [], [(0, 0)])]
    df = spark.createDataFrame(rows, "row_id long, id long, bloom_filter_seed long, bloom_filter_size long, block_offsets array<long>, ns_offsets array<struct<ns:long,block_offset:long>>")
    raw = index.encode_index(df)
    assert {r["row_id"]: len(r["raw"]) for r in raw.collect()} == {1: 56 + 24 + 32, 2: 56, 3: 56 + 16}
    back = {r["row_id"]: tuple(r)[1:] for r in index.decode_index(raw).collect()}
    assert back == {n: (i, s, z, b or [], o or [], None) for n, i, s, z, b, o in rows}
    bad = raw.select("row_id", F.when(F.col("row_id") == 1, F.expr("substring(raw, 1, 60)")).when(F.col("row_id") == 2, F.lit(bytearray(b"x"))).alias("raw"))
    assert {r["problem"] for r in index.decode_index(bad).collect()} == {"corrupt"}
