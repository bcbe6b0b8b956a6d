"""Queries that write durable stores and read them back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.extent_store import CompactionConfig, ExtentStore
from palimpsest.functions import codecs
from palimpsest.operators import index, journal, membership, segments
from palimpsest.operators import blocks as block_ops
from palimpsest.plans import kv, space
from palimpsest.session import shared_folder
from palimpsest.sources.logs import from_events, from_version_log
from palimpsest.sources.tables import table
from palimpsest.store import Store, StoreOptions
from palimpsest.streaming.ingest import ingest, latest_updates

# Parameters of the queries below; the SQL is made from the same values.
MAX_RUNS = 3
UNIT = 4096
STORE_BYTES = 1 << 22
FIRST_TIME = 1_000


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _synced(spark: SparkSession, folder: str) -> Store:
    """A store into which the events' runs were written one by one, and which was opened again; it merged runs on the way."""
    place = _place(spark)
    store = Store(spark, place, StoreOptions(max_runs=MAX_RUNS))
    log = from_events(table(spark, folder, "events"))
    for r in log.select("src").distinct().orderBy("src").collect():
        store.write_table(log.filter(F.col("src") == r["src"]), f"events-{r['src']}")
    store.close()
    return Store(spark, place, StoreOptions(max_runs=MAX_RUNS))


def store_synced(spark, folder):
    """Every version survives however often a store is synced."""
    return kv._text(_synced(spark, folder).log(), "is_delete")


def store_as_of(spark, folder):
    return kv._text(_synced(spark, folder).as_of(kv.AS_OF))


def store_horizon(spark, folder):
    """Compaction with a horizon: what is newer, and of what is not each key's newest version."""
    store = _synced(spark, folder)
    store.compact(horizon=kv.AS_OF)
    return kv._text(store.log(), "is_delete")


def store_index(spark, folder):
    """The index that is written with every run."""
    store = _synced(spark, folder)
    rows = store.index().groupBy("ns").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.sum("rows").alias("rows"))
    return rows.select("ns", F.col("first_key").cast("string").alias("first_key"), F.col("last_key").cast("string").alias("last_key"), "rows")


def store_verbs(spark, folder):
    """Puts, deletes and batches of a nation each, synced in between: the log as it is after opening the store again."""
    place = _place(spark)
    store = Store(spark, place)
    nations = table(spark, folder, "nation").orderBy("n_nationkey").collect()
    for n in nations:
        store.batch([("put_ns", n["n_regionkey"], n["n_name"].encode(), FIRST_TIME + n["n_nationkey"], b"first"), ("put", None, n["n_name"].encode(), FIRST_TIME, b"plain")])
    store.sync()
    for n in nations:
        name = n["n_name"].encode()
        if n["n_nationkey"] % 2:
            store.put_ns(n["n_regionkey"], name, b"second")
        if n["n_nationkey"] % 3 == 0:
            store.delete_ns(n["n_regionkey"], name)
        if n["n_nationkey"] % 5 == 0:
            store.delete(name)
        if n["n_nationkey"] % 7 == 0:
            store.put(name, b"again")
    store.close()
    rows = Store(spark, place).log().groupBy("ns", "key").agg(F.max(F.struct("ts", "seq", "is_delete", "value")).alias("t"), F.count("*").alias("versions"))
    return rows.select("ns", F.col("key").cast("string").alias("key"), F.col("t.is_delete").alias("deleted"), F.col("t.value").cast("string").alias("value"), "versions")


def _event_stream(spark: SparkSession, folder: str):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a pattern, since a stream takes no single file by its name
    return from_events(spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]"))


def stream_ingest(spark, folder):
    """The live keys of a store that took the events as a stream."""
    place = _place(spark)
    store = Store(spark, place)
    ingest(_event_stream(spark, folder), store, f"{place}-stream", available_now=True).awaitTermination()
    return kv._text(store.live())


def stream_latest(spark, folder):
    """The newest version of every key, as the running view of a stream leaves it."""
    place = _place(spark)
    rows = latest_updates(_event_stream(spark, folder))
    keep = lambda batch, number: batch.write.mode("append").parquet(f"{place}/{number}")
    rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}-stream").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{place}/*").groupBy("ns", "key").agg(F.max(F.struct("ts", "seq", "is_delete", "value")).alias("v"))
    return kv._text(updates.select("ns", "key", "v.ts", "v.value", "v.is_delete", "v.seq"), "is_delete", "seq")


def _extent_store(spark: SparkSession, folder: str) -> ExtentStore:
    """An extent for every nation, some bytes in those of one region, another region's deleted, opened again."""
    place = _place(spark)
    store = ExtentStore(spark, place, STORE_BYTES, seconds=lambda: 0)
    nations = table(spark, folder, "nation").orderBy("n_nationkey").collect()
    ids = {n["n_nationkey"]: store.create((n["n_nationkey"] + 1) * UNIT) for n in nations}
    for n in nations:
        if n["n_regionkey"] == 1:
            with store.open(ids[n["n_nationkey"]]) as handle:
                handle.write_at(10, n["n_name"].encode())
    for n in nations:
        if n["n_regionkey"] == 2:
            store.delete(ids[n["n_nationkey"]])
    return ExtentStore(spark, place, seconds=lambda: 0)


def extent_store_state(spark, folder):
    return _extent_store(spark, folder).extents().select("id", "range_start", "range_end", "length", "size")


def extent_store_replay(spark, folder):
    """What the store's journal gives when it is replayed."""
    return journal.replay_extents(_extent_store(spark, folder).journal()).select("id", "range_start", "range_end", "length", "size")


def extent_store_compacted(spark, folder):
    """After compaction every closed extent is as large as what was written, and space adds up."""
    store = _extent_store(spark, folder)
    store.maybe_compact(CompactionConfig(threshold=0.0, min_fragment=1, batch=100))
    whole = store.health().select("space_accounting_valid")
    return store.extents().select("id", "length", "size").crossJoin(F.broadcast(whole))


def codec_storage(spark, folder):
    """Stored forms of keys and values, loaded again: the bytes where the checksum holds."""
    rows = from_version_log(table(spark, folder, "version_log")).filter("value IS NOT NULL")
    ns, key, ts, value = (F.col(c) for c in ("ns", "key", "ts", "value"))
    stored = rows.select("seq", codecs.store_key(ns, key, ts).alias("k"), codecs.store_value(ns, value).alias("v"))
    broken = F.concat(F.expr("substring(v, 1, 4)"), F.expr("substring(v, 5, octet_length(v) - 4)"), F.lit(bytearray(b"!")))
    return stored.select(
        "seq", F.octet_length("k").alias("key_bytes"), F.octet_length("v").alias("value_bytes"), F.hex(codecs.load_key(F.col("k"))).alias("key"),
        F.hex(codecs.load_value(F.col("v"))).alias("value"), codecs.load_value(broken).isNull().alias("damage_seen"),
    )


def index_round_trip(spark, folder):
    """Stored index rows to bytes and back."""
    back = index.decode_index(index.encode_index(table(spark, folder, "segment_index")))
    joined = lambda c: F.array_join(c, ",")
    return back.select(
        "row_id", "id", "bloom_filter_seed", "bloom_filter_size", joined(F.transform("block_offsets", lambda x: x.cast("string"))).alias("blocks"),
        joined(F.transform("ns_offsets", lambda e: F.concat_ws(":", e["ns"].cast("string"), e["block_offset"].cast("string")))).alias("entries"), "problem",
    )


def bloom_probe(spark, folder):
    """Membership by filters, of the probes that these do not rule out by the log."""
    log = from_version_log(table(spark, folder, "version_log"))
    probes = table(spark, folder, "incoming_puts").select("in_id", F.coalesce("ns", F.lit(0)).alias("ns"), "key")
    maybe = membership.may_contain(probes, membership.build(log))
    return index.members(probes, index.members(maybe, log)).select("in_id")


def bloom_errors(spark, folder):
    """Filters by themselves: distinct probes, members among them, members that were ruled out, and whether wrong yeses are few."""
    log = from_version_log(table(spark, folder, "version_log"))
    probes = table(spark, folder, "incoming_puts").select(F.coalesce("ns", F.lit(0)).alias("ns"), "key").filter("key IS NOT NULL").distinct()
    said = membership.may_contain(probes, membership.build(log)).withColumn("said", F.lit(True))
    true = index.members(probes, log).withColumn("true", F.lit(True))
    one = probes.join(said, ["ns", "key"], "left").join(true, ["ns", "key"], "left").agg(
        F.count("*").alias("probes"), F.count("true").alias("members"), F.count_if(F.col("true") & F.col("said").isNull()).alias("missed"),
        F.count_if(F.col("true").isNull() & F.col("said")).alias("wrong"),
    )
    few = F.col("wrong") <= F.ceil(0.02 * (F.col("probes") - F.col("members")) + 10)
    return one.select("probes", "members", "missed", few.alias("wrong_is_rare"))


def segment_block(spark, folder):
    """One block of every segment that has so many."""
    placed = segments.layout(space._blocks(spark, folder), "segment_id", "block_id")
    return segments.read_block(placed, None, space.SEEK_BLOCK).select("segment_id", "block_id", "offset")


def block_splits(spark, folder):
    """Blocks filled in order by entries of which long ones begin in what is left of a block."""
    place = (F.col("block_id") * 65_536 + F.col("slot")).alias("place")
    rows = block_ops.entries_of(space._blocks(spark, folder), ["segment_id", "block_id"]).select("segment_id", place, F.octet_length("payload").alias("n"))
    return block_ops.fill_with_splits(rows, "segment_id", "place", F.col("n"))


QUERIES = {
    f.__name__: f
    for f in (
        store_synced, store_as_of, store_horizon, store_index, store_verbs, stream_ingest, stream_latest, extent_store_state, extent_store_replay, extent_store_compacted, codec_storage,
        index_round_trip, bloom_probe, bloom_errors, segment_block, block_splits,
    )
}

_EXTENTS = f"""
WITH n AS (SELECT n_nationkey AS id, n_regionkey AS region, (n_nationkey + 1) * {UNIT} AS size, octet_length(encode(n_name)) + 10 AS written FROM nation),
x AS (SELECT id::BIGINT AS id, {STORE_BYTES} - sum(size) OVER (ORDER BY id) AS range_start, size::BIGINT AS size,
        CASE WHEN region = 1 THEN written ELSE 0 END::BIGINT AS length, region FROM n)
"""

ORACLE = {
    "store_synced": kv._E + "SELECT ns, key, ts, value, is_delete FROM l",
    "store_as_of": kv._E.replace("FROM events)", f"FROM events WHERE epoch_us(ts) * 1000 <= {kv.AS_OF})") + f"SELECT ns, key, ts, value FROM ({kv._LIVE})",
    "store_horizon": kv._E
    + f"""SELECT ns, key, ts, value, is_delete FROM l WHERE ts > {kv.AS_OF}
       UNION ALL SELECT ns, key, ts, value, is_delete FROM (SELECT * FROM l WHERE ts <= {kv.AS_OF} {kv._TOP}) WHERE NOT is_delete""",
    "store_index": kv._E + "SELECT ns, min(encode(key))::VARCHAR AS first_key, max(encode(key))::VARCHAR AS last_key, count(*) AS rows FROM l GROUP BY ns",
    "store_verbs": """
WITH n AS (SELECT n_regionkey::BIGINT AS r, n_name AS key, n_nationkey AS i FROM nation),
a AS (SELECT r AS ns, key, 1 AS o, false AS gone, 'first' AS value FROM n UNION ALL SELECT 0, key, 0, false, 'plain' FROM n
  UNION ALL SELECT r, key, 10, false, 'second' FROM n WHERE i % 2 = 1 UNION ALL SELECT r, key, 20, true, NULL FROM n WHERE i % 3 = 0
  UNION ALL SELECT 0, key, 30, true, NULL FROM n WHERE i % 5 = 0 UNION ALL SELECT 0, key, 40, false, 'again' FROM n WHERE i % 7 = 0)
SELECT ns, key, arg_max(gone, o) AS deleted, last(value ORDER BY o) AS value, count(*) AS versions FROM a GROUP BY ns, key""",
    "stream_ingest": kv._E + f"SELECT ns, key, ts, value FROM ({kv._LIVE})",
    "stream_latest": kv.ORACLE["latest_all"],
    "extent_store_state": _EXTENTS + "SELECT id, range_start::BIGINT AS range_start, (range_start + size)::BIGINT AS range_end, length, size FROM x WHERE region <> 2",
    "extent_store_replay": _EXTENTS + "SELECT id, range_start::BIGINT AS range_start, (range_start + size)::BIGINT AS range_end, length, size FROM x WHERE region <> 2",
    "extent_store_compacted": _EXTENTS + "SELECT id, length, greatest(length, 1)::BIGINT AS size, true AS space_accounting_valid FROM x WHERE region <> 2",
    "codec_storage": kv._V
    + "SELECT seq, CAST(octet_length(k) + 32 AS INTEGER) AS key_bytes, CAST(vlen + 16 AS INTEGER) AS value_bytes, key, value, true AS damage_seen FROM l WHERE value IS NOT NULL",
    "index_round_trip": """
SELECT row_id, id, bloom_filter_seed, bloom_filter_size, array_to_string(coalesce(block_offsets, []), ',') AS blocks,
  array_to_string(list_transform(coalesce(ns_offsets, []), lambda e: concat(coalesce(e.ns, 0), ':', coalesce(e.block_offset, 0))), ',') AS entries,
  CAST(NULL AS VARCHAR) AS problem FROM segment_index""",
    "bloom_probe": kv.ORACLE["bloom_members"],
    "bloom_errors": kv._V
    + """, p AS (SELECT DISTINCT coalesce(ns, 0) AS ns, hex(key) AS key FROM incoming_puts WHERE key IS NOT NULL)
       SELECT count(*) AS probes, count(*) FILTER ((ns, key) IN (SELECT (ns, key) FROM l)) AS members, CAST(0 AS BIGINT) AS missed, true AS wrong_is_rare FROM p""",
    "segment_block": space._LAYOUT + f'SELECT segment_id, block_id, "offset" FROM z WHERE block_no = {space.SEEK_BLOCK}',
    "block_splits": """
WITH RECURSIVE b AS (SELECT DISTINCT * FROM blocks),
e AS (SELECT segment_id, block_id, unnest(entries) AS p, unnest(range(len(entries))) AS slot FROM b),
r AS (SELECT segment_id, block_id * 65536 + slot AS place, octet_length(p) AS n, row_number() OVER (PARTITION BY segment_id ORDER BY block_id * 65536 + slot) AS i FROM e WHERE p IS NOT NULL),
w AS (SELECT segment_id, NULL::BIGINT AS place, 0::BIGINT AS n, 0::BIGINT AS i, 0::BIGINT AS piece, 0::BIGINT AS start, 0::BIGINT AS bytes, 0::BIGINT AS block_no, -1::BIGINT AS slot, 0::BIGINT AS used
    FROM (SELECT DISTINCT segment_id FROM r)
  UNION ALL
  SELECT segment_id, place, n, i, piece, start, bytes, block_no + CASE WHEN opens THEN 1 ELSE 0 END, CASE WHEN opens THEN 0 ELSE slot + 1 END, CASE WHEN opens THEN 0 ELSE used END + bytes + 3
  FROM (SELECT *, slot >= 0 AND used + bytes + 3 > 4093 AS opens FROM (
    SELECT w.segment_id, coalesce(r.place, w.place) AS place, coalesce(r.n, w.n) AS n, coalesce(r.i, w.i) AS i, CASE WHEN r.i IS NULL THEN w.piece + 1 ELSE 0 END AS piece,
      CASE WHEN r.i IS NULL THEN w.start + w.bytes ELSE 0 END AS start, w.block_no, w.slot, w.used,
      CASE WHEN r.i IS NULL THEN least(w.n - w.start - w.bytes, 4090) WHEN r.n > 4090 AND w.slot >= 0 AND 4093 - w.used - 3 > 0 THEN least(r.n, 4093 - w.used - 3)
           ELSE least(r.n, 4090) END AS bytes
    FROM w LEFT JOIN r ON r.segment_id = w.segment_id AND r.i = w.i + 1 AND w.start + w.bytes >= w.n
    WHERE r.i IS NOT NULL OR w.start + w.bytes < w.n)))
SELECT segment_id, place, CAST(piece AS INTEGER) AS piece, CAST(CASE WHEN bytes = n THEN 0 WHEN start = 0 THEN 1 WHEN start + bytes = n THEN 3 ELSE 2 END AS INTEGER) AS flag,
  start, CAST(bytes AS INTEGER) AS bytes, block_no, CAST(slot AS INTEGER) AS slot FROM w WHERE i > 0""",
}
