"""Queries over the version log, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import clock
from palimpsest.functions import codecs
from palimpsest.functions.bounds import Bound, excluded, included
from palimpsest.operators import index, merge, reads, writes
from palimpsest.sources.logs import from_events, from_orders, from_version_log
from palimpsest.sources.tables import table

# Parameters of the queries below; the SQL is made from the same values.
POINT = (2, "17")
AS_OF = 1_704_500_000_000_000_000
LOW = included(2, b"20")
HIGH = included(255, b"30", 1_704_400_000_000_000_000)
ONE_NS = 256
RUN_LIMIT = 200_000
HLC_BASE = 1_750_000_000_000_000_000
ROWS_PER_BLOCK = 64


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(table(spark, folder, "events"))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return from_version_log(table(spark, folder, "version_log"))


def _text(rows: DataFrame, *more: str | Column) -> DataFrame:
    """Keys and values as text, for logs of text."""
    return rows.select("ns", F.col("key").cast("string").alias("key"), "ts", F.col("value").cast("string").alias("value"), *more)


def _hex(rows: DataFrame, *more: str | Column) -> DataFrame:
    return rows.select("ns", F.hex("key").alias("key"), "ts", F.hex("value").alias("value"), *more)


def kv_log_scan(spark, folder):
    return _text(_events(spark, folder), "is_delete", "seq", "src")


def latest_all(spark, folder):
    return _text(reads.latest(_events(spark, folder)), "is_delete", "seq")


def latest_live(spark, folder):
    return _text(reads.live(_events(spark, folder)), "seq")


def latest_version_log(spark, folder):
    return _hex(reads.live(_log(spark, folder)), "seq")


def latest_by_arrival(spark, folder):
    return _text(reads.latest(from_orders(table(spark, folder, "orders")), by="arrival"), "seq")


def latest_with_ties(spark, folder):
    return _text(reads.latest(from_orders(table(spark, folder, "orders"))), "seq")


def delete_raw_view(spark, folder):
    return _text(reads.raw_view(_events(spark, folder)), "is_delete")


def get_point(spark, folder):
    return _text(reads.get(_events(spark, folder), POINT[1].encode(), POINT[0]), "seq")


def multi_get(spark, folder):
    keys = table(spark, folder, "customer").select(F.lit(0).alias("ns"), F.col("c_custkey").cast("string").cast("binary").alias("key"))
    return _text(reads.multi_get(from_orders(table(spark, folder, "orders")), keys), "seq")


def multi_get_incoming(spark, folder):
    return _hex(reads.multi_get(_log(spark, folder), table(spark, folder, "incoming_puts").select("ns", "key")), "seq")


def as_of_snapshot(spark, folder):
    return _text(reads.as_of(_events(spark, folder), AS_OF), "seq")


def version_history(spark, folder):
    return _text(reads.history(_events(spark, folder)), "version", "age_ns", "changed")


def version_counts(spark, folder):
    return reads.version_counts(_log(spark, folder)).withColumn("key", F.hex("key"))


def scan_range(spark, folder):
    return _text(reads.scan(_events(spark, folder), LOW, HIGH, ordered=False), "is_delete")


def scan_range_excluded(spark, folder):
    lo, hi = excluded(HIGH.ns, HIGH.key, HIGH.ts), excluded(300, b"30")
    return _text(reads.scan(_events(spark, folder), lo, hi, ordered=False), "is_delete")


def scan_from_oldest(spark, folder):
    return _text(reads.scan(_events(spark, folder), None, excluded(1, b"5", 0), ordered=False), "is_delete")


def scan_namespace(spark, folder):
    return _text(reads.scan_namespace(_events(spark, folder), ONE_NS, ordered=False), "is_delete")


def scan_live_range(spark, folder):
    return _text(reads.scan_live(_events(spark, folder), LOW, HIGH))


def batch_normalize(spark, folder):
    ops = writes.normalise_batch(table(spark, folder, "incoming_puts"), "in_id", "val")
    return _hex(ops, "is_delete", "seq")


def batch_rejected(spark, folder):
    return writes.rejected_operations(table(spark, folder, "incoming_puts"), "in_id")


def batch_then_latest(spark, folder):
    ops = writes.normalise_batch(table(spark, folder, "incoming_puts"), "in_id", "val", src=1_000)
    later = ops.withColumn("seq", F.col("seq") + 10**12)
    return _hex(reads.live(_log(spark, folder).unionByName(later)), "seq")


def upsert_exact_version(spark, folder):
    return _hex(writes.exact_versions(_log(spark, folder)), "seq", "src")


def upsert_across_runs(spark, folder):
    return _hex(writes.exact_versions(_log(spark, folder), per_run=False), "seq")


def memtable_size(spark, folder):
    return writes.run_sizes(_log(spark, folder))


def admission(spark, folder):
    return writes.admission(_log(spark, folder), RUN_LIMIT).select("seq", "src", "running_bytes", "admitted")


def merge_all_versions(spark, folder):
    return _hex(merge.merge_positions(_log(spark, folder)), "src", "seq", "pos")


def merge_range(spark, folder):
    lo, hi = Bound(1, b""), Bound(300, b"")
    return _hex(merge.merge_positions(_log(spark, folder), lo, hi), "src", "seq", "pos")


def merge_full_scan(spark, folder):
    return _hex(merge.merge(_log(spark, folder)), "src", "seq")


def merge_range_first(spark, folder):
    return _hex(merge.first_of_merge(_log(spark, folder), Bound(300, b"")), "src", "seq")


def merge_latest_keys(spark, folder):
    probes = table(spark, folder, "incoming_puts").select(F.coalesce("ns", F.lit(0)).alias("ns"), "key").filter("key IS NOT NULL")
    return _hex(merge.first_per_probe(_log(spark, folder), probes), "is_delete", "seq")


def compact_runs(spark, folder):
    return _hex(merge.compact(_log(spark, folder)), "is_delete", "seq")


def compact_full(spark, folder):
    return _hex(merge.compact(_log(spark, folder), drop_tombstones=True), "seq")


def run_stats(spark, folder):
    return merge.run_stats(_log(spark, folder))


def run_overlap(spark, folder):
    return merge.overlap(_log(spark, folder))


def hlc_assign(spark, folder):
    return clock.stamp(table(spark, folder, "events").select(F.col("event_id").alias("seq")), HLC_BASE, ["seq"])


def codec_memory(spark, folder):
    log = _events(spark, folder)
    ns, key, ts = F.col("ns"), F.col("key"), F.col("ts")
    return log.select(
        "seq",
        F.hex(codecs.encode_key(ns, key, ts)).alias("key_form"),
        F.hex(codecs.encode_pointer(ns, key)).alias("pointer_form"),
        F.hex(codecs.encode_value(ns, F.coalesce("value", F.lit(bytearray(b""))))).alias("value_form"),
    )


def codec_round_trip(spark, folder):
    log = _log(spark, folder)
    raw = codecs.encode_key(F.col("ns"), F.col("key"), F.col("ts"))
    back = log.select("seq", raw.alias("r")).select("seq", codecs.decode_ns(F.col("r")).alias("ns"), F.hex(codecs.decode_key(F.col("r"))).alias("key"), codecs.decode_ts(F.col("r")).alias("ts"))
    return back


def crc_verify(spark, folder):
    log = table(spark, folder, "version_log").filter("val IS NOT NULL")
    state = F.when(F.col("val_crc").isNull(), "none").when(F.crc32("val") == F.col("val_crc"), "ok").otherwise("damaged")
    return log.select("seq", state.alias("checksum"))


def sparse_index(spark, folder):
    return index.sparse_index(index.blocked(_log(spark, folder), ROWS_PER_BLOCK)).withColumn("key", F.hex("key"))


def ns_first_block(spark, folder):
    return index.namespace_offsets(index.blocked(_log(spark, folder), ROWS_PER_BLOCK))


def index_lookup(spark, folder):
    sparse = index.sparse_index(index.blocked(_log(spark, folder), ROWS_PER_BLOCK))
    probes = table(spark, folder, "incoming_puts").select(F.coalesce("ns", F.lit(0)).alias("ns"), "key").filter("key IS NOT NULL")
    return index.lookup(sparse, probes).withColumn("key", F.hex("key"))


def _probes(spark, folder):
    return table(spark, folder, "incoming_puts").select("in_id", F.coalesce("ns", F.lit(0)).alias("ns"), "key")


def bloom_members(spark, folder):
    return index.members(_probes(spark, folder), _log(spark, folder)).select("in_id")


def bloom_non_members(spark, folder):
    return index.non_members(_probes(spark, folder), _log(spark, folder)).select("in_id")


QUERIES = {
    f.__name__: f
    for f in (
        kv_log_scan, latest_all, latest_live, latest_version_log, latest_by_arrival, latest_with_ties, delete_raw_view, get_point,
        multi_get, multi_get_incoming, as_of_snapshot, version_history, version_counts, scan_range, scan_range_excluded,
        scan_from_oldest, scan_namespace, scan_live_range, batch_normalize, batch_rejected, batch_then_latest, upsert_exact_version,
        upsert_across_runs, memtable_size, admission, merge_all_versions, merge_range, merge_full_scan, merge_range_first,
        merge_latest_keys, compact_runs, compact_full, run_stats, run_overlap, hlc_assign, codec_memory, codec_round_trip,
        crc_verify, sparse_index, ns_first_block, index_lookup, bloom_members, bloom_non_members,
    )
}

_E = """
WITH l AS (
  SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 255 WHEN 'signup' THEN 256
              WHEN 'error' THEN 300 ELSE 0 END::BIGINT AS ns,
         CAST(user_id AS VARCHAR) AS key, epoch_us(ts) * 1000 AS ts,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value,
         coalesce(event_type = 'error', false) AS is_delete, event_id AS seq, CAST(event_id % 8 AS INTEGER) AS src FROM events)
"""
_O = """
WITH l AS (
  SELECT 0::BIGINT AS ns, CAST(o_custkey AS VARCHAR) AS key, epoch_us(o_orderdate) * 1000 AS ts, o_orderstatus AS value, o_orderkey AS seq
  FROM orders)
"""
_V = f"""
WITH l AS (
  SELECT coalesce(ns, 0) AS ns, key AS k, hex(key) AS key, CASE WHEN ts < {10**17} THEN ts * 1000 ELSE ts END AS ts,
         CASE WHEN coalesce(is_delete, false) THEN NULL ELSE hex(val) END AS value, octet_length(CASE WHEN coalesce(is_delete, false) THEN NULL ELSE val END) AS vlen,
         coalesce(is_delete, false) AS is_delete, seq, src
  FROM version_log WHERE key IS NOT NULL AND ts > 0 AND coalesce(ns, 0) >= 0)
"""
_TOP = "QUALIFY row_number() OVER (PARTITION BY ns, key ORDER BY ts DESC, seq DESC) = 1"
_LIVE = f"SELECT * FROM (SELECT * FROM l {_TOP}) WHERE NOT is_delete"
_ORDER = "ns, k, ts DESC, src DESC, seq DESC"
_FORM = "3 * (24 + octet_length(k)) + 8 + coalesce(vlen, 0) + 16"
_OPS = """
  SELECT CASE WHEN lower(trim(op)) IN ('put', 'delete') THEN 0 ELSE coalesce(ns, 0) END AS ns, key AS k, hex(key) AS key, ts,
         CASE WHEN lower(trim(op)) IN ('delete', 'delete_ns') THEN NULL ELSE hex(val) END AS value,
         lower(trim(op)) IN ('delete', 'delete_ns') AS is_delete, in_id AS seq
  FROM incoming_puts WHERE lower(trim(op)) IN ('put', 'delete', 'put_ns', 'delete_ns') AND key IS NOT NULL AND ts > 0
"""
_PROBES = "SELECT DISTINCT coalesce(ns, 0) AS ns, hex(key) AS key, key AS k FROM incoming_puts WHERE key IS NOT NULL"


def _le(x: str, width: int = 8) -> str:
    h = f"lpad(hex({x}), 16, '0')"
    return " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(width))


# CRC-32 of `val`, a byte at a time: the table of 256 remainders, then a fold over the value's bytes.
CRC_SQL = """
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
c AS (
  SELECT v.*, CASE WHEN val IS NOT NULL THEN xor(list_reduce(
    list_transform(range(octet_length(val)), lambda i: CAST('0x' || substr(hex(val), 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) END AS crc
  FROM version_log v, tab)
"""
_BLOCKS = f", b AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS pos, (row_number() OVER (ORDER BY {_ORDER}) - 1) // {ROWS_PER_BLOCK} AS block_no FROM l)"
_SPARSE = ", i AS (SELECT block_no, min_by(ns, pos) AS ns, min_by(k, pos) AS k, min_by(ts, pos) AS ts, count(*) AS rows FROM b GROUP BY block_no)"

ORACLE = {
    "kv_log_scan": _E + "SELECT * FROM l",
    "latest_all": _E + f"SELECT ns, key, ts, value, is_delete, seq FROM l {_TOP}",
    "latest_live": _E + f"SELECT ns, key, ts, value, seq FROM ({_LIVE})",
    "latest_version_log": _V + f"SELECT ns, key, ts, value, seq FROM ({_LIVE})",
    "latest_by_arrival": _O + "SELECT ns, key, ts, value, seq FROM l QUALIFY row_number() OVER (PARTITION BY ns, key ORDER BY seq DESC) = 1",
    "latest_with_ties": _O + f"SELECT ns, key, ts, value, seq FROM l {_TOP}",
    "delete_raw_view": _E + f"SELECT ns, key, ts, CASE WHEN is_delete THEN '' ELSE value END AS value, is_delete FROM l {_TOP}",
    "get_point": _E + f"SELECT ns, key, ts, value, seq FROM ({_LIVE}) WHERE ns = {POINT[0]} AND key = '{POINT[1]}'",
    "multi_get": _O + f"SELECT ns, key, ts, value, seq FROM l WHERE key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) {_TOP}",
    "multi_get_incoming": _V + f", p AS ({_PROBES}) SELECT ns, key, ts, value, seq FROM ({_LIVE}) WHERE (ns, key) IN (SELECT (ns, key) FROM p)",
    "as_of_snapshot": _E.replace("FROM events)", f"FROM events WHERE epoch_us(ts) * 1000 <= {AS_OF})") + f"SELECT ns, key, ts, value, seq FROM ({_LIVE})",
    "version_history": _E
    + """SELECT ns, key, ts, value, row_number() OVER w AS version, ts - lead(ts) OVER w AS age_ns,
       lead(value) OVER w IS DISTINCT FROM value AS changed FROM l WINDOW w AS (PARTITION BY ns, key ORDER BY ts DESC, seq DESC)""",
    "version_counts": _V
    + """SELECT ns, key, count(*) AS versions, count(*) FILTER (is_delete) AS tombstones, min(ts) AS first_ts, max(ts) AS last_ts
       FROM l GROUP BY ns, key""",
    "scan_range": _E
    + f"""SELECT ns, key, ts, value, is_delete FROM l WHERE (ns > {LOW.ns} OR (ns = {LOW.ns} AND key >= '{LOW.key.decode()}'))
       AND (ns < {HIGH.ns} OR (ns = {HIGH.ns} AND (key < '{HIGH.key.decode()}' OR (key = '{HIGH.key.decode()}' AND ts >= {HIGH.ts}))))""",
    "scan_range_excluded": _E
    + f"""SELECT ns, key, ts, value, is_delete FROM l
       WHERE (ns > {HIGH.ns} OR (ns = {HIGH.ns} AND (key > '{HIGH.key.decode()}' OR (key = '{HIGH.key.decode()}' AND ts < {HIGH.ts}))))
       AND (ns < 300 OR (ns = 300 AND key < '30'))""",
    "scan_from_oldest": _E + "SELECT ns, key, ts, value, is_delete FROM l WHERE ns < 1 OR (ns = 1 AND key <= '5')",
    "scan_namespace": _E + f"SELECT ns, key, ts, value, is_delete FROM l WHERE ns = {ONE_NS}",
    "scan_live_range": _E.rstrip()
    + f""", r AS (SELECT * FROM l WHERE (ns > {LOW.ns} OR (ns = {LOW.ns} AND key >= '{LOW.key.decode()}'))
       AND (ns < {HIGH.ns} OR (ns = {HIGH.ns} AND (key < '{HIGH.key.decode()}' OR (key = '{HIGH.key.decode()}' AND ts >= {HIGH.ts})))))
       SELECT ns, key, ts, value FROM (SELECT * FROM r {_TOP}) WHERE NOT is_delete""",
    "batch_normalize": f"SELECT ns, key, ts, value, is_delete, seq FROM ({_OPS}) WHERE ns >= 0",
    "batch_rejected": """
SELECT * FROM (SELECT in_id AS seq, CASE WHEN coalesce(lower(trim(op)) NOT IN ('put', 'delete', 'put_ns', 'delete_ns'), true) THEN 'operation'
  WHEN key IS NULL THEN 'key' WHEN coalesce(ts, 0) <= 0 THEN 'version time' WHEN lower(trim(op)) LIKE '%_ns' AND ns < 0 THEN 'namespace' END AS reason
  FROM incoming_puts) WHERE reason IS NOT NULL""",
    "batch_then_latest": _V.rstrip().replace("WITH l AS", "WITH v AS")
    + f""", l AS (SELECT ns, key, ts, value, is_delete, seq FROM v UNION ALL SELECT ns, key, ts, value, is_delete, seq + 1000000000000 FROM ({_OPS}))
       SELECT ns, key, ts, value, seq FROM ({_LIVE})""",
    "upsert_exact_version": _V
    + "SELECT ns, key, ts, value, seq, src FROM l QUALIFY row_number() OVER (PARTITION BY ns, key, ts, src ORDER BY seq DESC) = 1",
    "upsert_across_runs": _V + "SELECT ns, key, ts, value, seq FROM l QUALIFY row_number() OVER (PARTITION BY ns, key, ts ORDER BY seq DESC) = 1",
    "memtable_size": _V + f"SELECT src, count(*) AS rows, CAST(sum({_FORM}) AS BIGINT) AS bytes FROM l GROUP BY src",
    "admission": _V
    + f"""SELECT seq, src, running_bytes, running_bytes <= {RUN_LIMIT} AS admitted FROM (
       SELECT seq, src, CAST(sum({_FORM}) OVER (PARTITION BY src ORDER BY seq) AS BIGINT) AS running_bytes FROM l)""",
    "merge_all_versions": _V + f"SELECT ns, key, ts, value, src, seq, row_number() OVER (ORDER BY {_ORDER}) AS pos FROM l",
    "merge_range": _V + f"SELECT ns, key, ts, value, src, seq, row_number() OVER (ORDER BY {_ORDER}) AS pos FROM l WHERE ns >= 1 AND ns < 300",
    "merge_full_scan": _V + f"SELECT ns, key, ts, value, src, seq FROM l ORDER BY {_ORDER}",
    "merge_range_first": _V + f"SELECT ns, key, ts, value, src, seq FROM l WHERE ns >= 300 ORDER BY {_ORDER} LIMIT 1",
    "merge_latest_keys": _V + f", p AS ({_PROBES}) SELECT ns, key, ts, value, is_delete, seq FROM l WHERE (ns, key) IN (SELECT (ns, key) FROM p) {_TOP}",
    "compact_runs": _V + f"SELECT ns, key, ts, value, is_delete, seq FROM l {_TOP}",
    "compact_full": _V + f"SELECT ns, key, ts, value, seq FROM ({_LIVE})",
    "run_stats": _V
    + """SELECT src, count(*) AS rows, count(DISTINCT (ns, key)) AS keys, count(*) FILTER (is_delete) AS tombstones, count(DISTINCT ns) AS namespaces,
       min(ts) AS min_ts, max(ts) AS max_ts FROM l GROUP BY src""",
    "run_overlap": _V + "SELECT runs, count(*) AS keys FROM (SELECT count(DISTINCT src) AS runs FROM l GROUP BY ns, key) GROUP BY runs",
    "hlc_assign": f"SELECT event_id AS seq, {HLC_BASE} + row_number() OVER (ORDER BY event_id) - 1 AS ts FROM events",
    "codec_memory": _E
    + f"""SELECT seq, {_le('ns')} || hex(key) || {_le('~ts')} || repeat('FF', 8) AS key_form,
       {_le('ns')} || hex(key) || repeat('FF', 16) AS pointer_form, {_le('ns')} || hex(coalesce(value, '')) AS value_form FROM l""",
    "codec_round_trip": _V + "SELECT seq, ns, key, ts FROM l",
    "crc_verify": CRC_SQL
    + "SELECT seq, CASE WHEN val_crc IS NULL THEN 'none' WHEN crc = val_crc THEN 'ok' ELSE 'damaged' END AS checksum FROM c WHERE val IS NOT NULL",
    "sparse_index": _V.rstrip() + _BLOCKS + _SPARSE + " SELECT block_no, ns, hex(k) AS key, ts, rows FROM i",
    "ns_first_block": _V.rstrip() + _BLOCKS + " SELECT ns, min(block_no) AS first_block, max(block_no) AS last_block, count(*) AS rows FROM b GROUP BY ns",
    "index_lookup": _V.rstrip() + _BLOCKS + _SPARSE
    + f""", p AS ({_PROBES}), u AS (SELECT ns, k, 1 AS probe, block_no FROM i UNION ALL SELECT ns, k, 0, NULL FROM p)
       SELECT ns, hex(k) AS key, block_no FROM (SELECT ns, k, probe, max(block_no) OVER (ORDER BY ns, k, probe ROWS UNBOUNDED PRECEDING) AS block_no FROM u) WHERE probe = 0""",
    "bloom_members": _V + "SELECT in_id FROM incoming_puts p WHERE EXISTS (SELECT 1 FROM l WHERE l.ns = coalesce(p.ns, 0) AND l.k = p.key)",
    "bloom_non_members": _V + "SELECT in_id FROM incoming_puts p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.ns = coalesce(p.ns, 0) AND l.k = p.key)",
}
