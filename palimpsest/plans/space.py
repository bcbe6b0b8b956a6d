"""Queries over the extent store, its journal, blocks and segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import blocks, extents, index, journal, segments
from palimpsest.sources.tables import table

# Parameters of the queries below; the SQL is made from the same values.
DATA_START = extents.HEADER_BYTES + extents.METADATA_BYTES + extents.JOURNAL_BYTES
CAPACITY = 1 << 33
FIT_BYTES = 65_536
JOURNAL_BYTES = 65_536
SEGMENT_BYTES = 12 * 4096
CHUNK_BYTES = 1000
SEEK_BLOCK = 3
SLOT = 1


def _extents(spark: SparkSession, folder: str) -> DataFrame:
    return extents.current_extents(table(spark, folder, "extents"))


def _free(spark: SparkSession, folder: str) -> DataFrame:
    return extents.free_ranges(_extents(spark, folder), DATA_START, CAPACITY)


def _journal(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "journal")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per snapshot in the extents table, of its size times a spread factor."""
    rows = table(spark, folder, "extents").filter("id IS NOT NULL AND size IS NOT NULL")
    return rows.groupBy("id").agg((F.max("size") * (1 + F.pmod("id", F.lit(1000)) * 50)).alias("size"))


def _writes(spark: SparkSession, folder: str) -> DataFrame:
    """What an extent's length says was written."""
    rows = _extents(spark, folder).filter("length > 0")
    return rows.select(F.col("range_start").alias("start"), (F.col("range_start") + F.col("length")).alias("end"))


def current_extents(spark, folder):
    return _extents(spark, folder)


def free_ranges(spark, folder):
    return _free(spark, folder)


def free_total(spark, folder):
    return extents.total_free(_free(spark, folder))


def used_total(spark, folder):
    return extents.total_used(_extents(spark, folder))


def frag_stats(spark, folder):
    return extents.fragmentation(_free(spark, folder))


def can_allocate(spark, folder):
    return extents.can_allocate(_requests(spark, folder), _free(spark, folder))


def alloc_classify(spark, folder):
    return extents.classify_allocation(_requests(spark, folder), _free(spark, folder))


def rightmost_fit(spark, folder):
    return extents.rightmost_fit(_free(spark, folder), FIT_BYTES, DATA_START)


def after_allocation(spark, folder):
    free = _free(spark, folder)
    return extents.after_allocation(free, extents.rightmost_fit(free, FIT_BYTES, DATA_START))


def coalesce_ranges(spark, folder):
    rows = _journal(spark, folder).select(F.explode("free_ranges").alias("r")).select(F.col("r.range_start").alias("start"), F.col("r.range_end").alias("end"))
    return extents.coalesce_ranges(rows)


def delete_extents(spark, folder):
    ids = table(spark, folder, "open_extents").select("id")
    return extents.delete_extents(_extents(spark, folder), _free(spark, folder), ids)[1]


def compaction_trigger(spark, folder):
    return extents.compaction_trigger(_free(spark, folder), _extents(spark, folder)).withColumn("ratio", F.round("ratio", 9))


def compaction_candidates(spark, folder):
    return extents.compaction_candidates(_extents(spark, folder), table(spark, folder, "open_extents")).select("id", "unused")


def compaction_candidates_all(spark, folder):
    return extents.compaction_candidates(_extents(spark, folder), table(spark, folder, "open_extents"), batch=None).select("id", "unused")


def dirty_pages(spark, folder):
    return extents.dirty_pages(_writes(spark, folder))


def consolidate_pages(spark, folder):
    return extents.consolidate_pages(extents.dirty_pages(_writes(spark, folder)))


def write_ranges(spark, folder):
    return extents.write_ranges(_writes(spark, folder))


def fs_health(spark, folder):
    return extents.health(_free(spark, folder), _extents(spark, folder), CAPACITY - DATA_START)


def extent_records(spark, folder):
    """Extents to their records and back."""
    return extents.read_extent_records(extents.extent_records(_extents(spark, folder)))


def range_records(spark, folder):
    """Free ranges to their records and back."""
    return extents.read_range_records(extents.range_records(_free(spark, folder)))


def metadata_growth(spark, folder):
    return extents.metadata_growth(_free(spark, folder), _extents(spark, folder), DATA_START)


def journal_entry_size(spark, folder):
    return journal.entry_sizes(_journal(spark, folder))


def journal_text(spark, folder):
    rows = journal.decode_entries(journal.encode_entries(_journal(spark, folder)))
    ranges = F.when(F.col("free_ranges").isNotNull(), F.size("free_ranges"))
    return rows.select("seq", "entry_type", "entry_time", "frange_id", F.col("metadata.range_start").alias("range_start"), F.col("metadata.modified_at").alias("modified_at"), ranges.alias("ranges"))


def journal_retention(spark, folder):
    return journal.retention(_journal(spark, folder), JOURNAL_BYTES)


def journal_replay(spark, folder):
    return journal.replay_extents(_journal(spark, folder))


def journal_free(spark, folder):
    return journal.replay_free(_journal(spark, folder))


def journal_next_id(spark, folder):
    return journal.next_id(_journal(spark, folder))


def journal_drift(spark, folder):
    return journal.drift(journal.replay_extents(_journal(spark, folder)), _extents(spark, folder))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").distinct()


def block_chunking(spark, folder):
    rows = blocks.chunks(table(spark, folder, "documents").filter("text IS NOT NULL"), ["doc_id"], "text", CHUNK_BYTES)
    return rows.select("doc_id", "piece", "flag", F.octet_length("payload").alias("bytes"), F.md5("payload").alias("digest"))


def block_packing(spark, folder):
    place = (F.col("block_id") * 65_536 + F.col("slot")).alias("place")
    rows = blocks.entries_of(_blocks(spark, folder), ["segment_id", "block_id"]).select("segment_id", place, "payload")
    pieces = blocks.chunks(rows, ["segment_id", "place"], "payload").select("segment_id", "place", "piece", F.octet_length("payload").alias("bytes"))
    return blocks.fill_in_order(pieces, "segment_id", ["place", "piece"], F.col("bytes"))


def block_stats(spark, folder):
    return blocks.block_stats(_blocks(spark, folder), ["block_id"])


def block_entries(spark, folder):
    rows = blocks.entries_of(_blocks(spark, folder), ["block_id"])
    return rows.select("block_id", "slot", F.octet_length("payload").alias("bytes"), F.md5("payload").alias("digest"))


def block_entry_at(spark, folder):
    return blocks.entry_at(_blocks(spark, folder), ["block_id"], SLOT).select("block_id", F.md5("payload").alias("digest"))


def block_offsets(spark, folder):
    rows = blocks.end_offsets(_blocks(spark, folder).filter("entries IS NOT NULL"), ["block_id"])
    return rows.select("block_id", F.concat_ws(",", F.transform("offsets", lambda x: x.cast("string"))).alias("offsets"), "stored_ok")


def block_pages(spark, folder):
    """All blocks to bytes and back, full ones and those of several pages too."""
    back = blocks.entries_of_pages(blocks.lay_out_pages(_blocks(spark, folder), ["block_id"]), ["block_id"])
    return back.select("block_id", "slot", F.octet_length("payload").alias("bytes"), F.md5("payload").alias("digest"))


def segment_layout(spark, folder):
    return segments.layout(_blocks(spark, folder), "segment_id", "block_id", SEGMENT_BYTES)


def segment_seek(spark, folder):
    placed = segments.layout(_blocks(spark, folder), "segment_id", "block_id")
    return segments.seek(placed, SEEK_BLOCK).select("segment_id", "block_no", "block_id")


def segment_remaining(spark, folder):
    return segments.remaining(segments.layout(_blocks(spark, folder), "segment_id", "block_id"), SEEK_BLOCK)


def segment_stats(spark, folder):
    stats = blocks.block_stats(_blocks(spark, folder), ["segment_id", "block_id"])
    return segments.segment_stats(stats)


def stored_index_checks(spark, folder):
    return index.stored_index_checks(table(spark, folder, "segment_index"))


QUERIES = {
    f.__name__: f
    for f in (
        current_extents, free_ranges, free_total, used_total, frag_stats, can_allocate, alloc_classify, rightmost_fit, after_allocation,
        coalesce_ranges, delete_extents, compaction_trigger, compaction_candidates, compaction_candidates_all, dirty_pages,
        consolidate_pages, write_ranges, fs_health, extent_records, range_records, metadata_growth, journal_entry_size, journal_text, journal_retention, journal_replay, journal_free,
        journal_next_id, journal_drift, block_chunking, block_packing, block_stats, block_entries, block_entry_at, block_offsets,
        block_pages, segment_layout, segment_seek, segment_remaining, segment_stats,
        stored_index_checks,
    )
}

_X = """
WITH x AS (
  SELECT id, range_start, range_end, coalesce(length, 0) AS length, size, created_at, modified_at FROM (
    SELECT * FROM extents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC NULLS LAST,
      created_at DESC NULLS LAST, (deleted_at IS NULL) DESC, deleted_at DESC NULLS LAST, range_start DESC NULLS LAST, range_end DESC NULLS LAST,
      length DESC NULLS LAST, size DESC NULLS LAST) = 1)
  WHERE deleted_at IS NULL)"""


def _islands(name: str, source: str) -> str:
    """SQL of the unions of touching ranges in ``source``."""
    return f""", {name}_m AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM ({source}) WHERE s < e),
{name}_g AS (SELECT s, e, sum(CASE WHEN s <= upto THEN 0 ELSE 1 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_m),
{name} AS (SELECT min(s) AS s, max(e) AS e FROM {name}_g GROUP BY g)"""


_FREE = (
    _X
    + _islands(
        "u",
        f"""SELECT range_start AS s, range_end AS e FROM x WHERE range_end > {DATA_START} AND range_start < {CAPACITY}
            UNION ALL SELECT {DATA_START} - 1, {DATA_START} UNION ALL SELECT {CAPACITY}, {CAPACITY} + 1""",
    )
    + ", f AS (SELECT * FROM (SELECT e AS s, lead(s) OVER (ORDER BY s) AS e FROM u) WHERE e IS NOT NULL)"
)
_SPACE = _FREE + ", n AS (SELECT s, e FROM f)"
_REQ = ", r AS (SELECT id, max(size) * (1 + (id % 1000) * 50) AS size FROM extents WHERE id IS NOT NULL AND size IS NOT NULL GROUP BY id)"
_FIT = f", t AS (SELECT s, e FROM n WHERE e - s >= {FIT_BYTES} AND s >= {DATA_START} ORDER BY s DESC, e DESC LIMIT 1)"
_STATS = """SELECT coalesce(CAST(sum(e - s) AS BIGINT), 0) AS total_free_space, count(*) AS free_range_count, coalesce(max(e - s), 0) AS largest_free_block,
  coalesce(CAST(sum(e - s) // count(*) AS BIGINT), 0) AS average_fragment_size, count(*) FILTER (e - s < 4096) AS small_fragments FROM """
_WRITES = ", w AS (SELECT range_start AS s, range_start + length AS e FROM x WHERE length > 0)"
_PAGES = _X + _WRITES + ", p AS (SELECT DISTINCT unnest(range(s // 4096, (e - 1) // 4096 + 1)) AS page FROM w)"
_SIZE = """18 + CASE WHEN metadata IS NULL THEN 0 ELSE 48 END + 1 + CASE WHEN free_ranges IS NULL THEN 0 ELSE 8 + 16 * len(free_ranges) END"""
_EPOCH = """
WITH own AS (SELECT seq, entry_type, frange_id, metadata AS m FROM journal WHERE entry_type IN (1, 2, 3) AND frange_id IS NOT NULL
             AND (entry_type = 2 OR metadata IS NOT NULL)),
ep AS (SELECT *, coalesce(sum(CASE WHEN entry_type = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY frange_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM own),
made AS (SELECT frange_id, epoch, min(seq) AS c, min_by(m, seq) AS base FROM ep WHERE entry_type = 1 GROUP BY ALL),
life AS (SELECT frange_id AS id, epoch, any_value(base) AS base, min(seq) FILTER (entry_type = 2) AS gone,
           max_by(m, seq) FILTER (entry_type = 3 AND seq > c) AS u
         FROM made JOIN ep USING (frange_id, epoch) GROUP BY ALL)
"""
_REPLAY = """
SELECT id, base.range_start AS range_start, base.range_end AS range_end, CASE WHEN u IS NULL THEN base.length ELSE u.length END AS length,
  base.size AS size, base.created_at AS created_at, CASE WHEN u IS NULL THEN base.modified_at ELSE u.modified_at END AS modified_at
FROM life WHERE gone IS NULL
"""
_B = "WITH b AS (SELECT DISTINCT * FROM blocks), e AS (SELECT segment_id, block_id, unnest(entries) AS p, unnest(range(len(entries))) AS slot FROM b)"
_HELD = "WITH b AS (SELECT DISTINCT * FROM blocks), k AS (SELECT *, len(list_filter(coalesce(entries, []), lambda x: x IS NOT NULL)) AS n, coalesce(list_sum(list_transform(list_filter(entries, lambda x: x IS NOT NULL), lambda x: octet_length(x))), 0) AS y FROM b)"
_LAYOUT = f"""
WITH o AS (SELECT DISTINCT segment_id, block_id FROM blocks),
y AS (SELECT segment_id, block_id, row_number() OVER (PARTITION BY segment_id ORDER BY block_id) - 1 AS block_no FROM o),
z AS (SELECT *, block_no * 4096 AS "offset", block_no * 4096 + 4096 <= {SEGMENT_BYTES} AS stored FROM y)
"""

ORACLE = {
    "current_extents": _X + " SELECT * FROM x",
    "free_ranges": _FREE + ' SELECT s AS "start", e AS "end" FROM f',
    "free_total": _FREE + " SELECT CAST(coalesce(sum(e - s), 0) AS BIGINT) AS free_bytes FROM f",
    "used_total": _X + " SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS used_bytes FROM x",
    "frag_stats": _SPACE + " " + _STATS + "n",
    "can_allocate": _SPACE + _REQ + " SELECT id, size, coalesce((SELECT max(e - s) FROM n), 0) >= size AS fits FROM r",
    "alloc_classify": _SPACE
    + _REQ
    + """ SELECT id, size, CASE WHEN coalesce((SELECT max(e - s) FROM n), 0) >= size THEN 'ok'
      WHEN size > coalesce((SELECT sum(e - s) FROM n), 0) THEN 'storage exhausted' ELSE 'fragmentation limit' END AS outcome FROM r""",
    "rightmost_fit": _SPACE + _FIT + f' SELECT e - {FIT_BYTES} AS "start", e AS "end", s AS free_start, e AS free_end FROM t',
    "after_allocation": _SPACE
    + _FIT
    + f""" SELECT s AS "start", e AS "end" FROM n WHERE (s, e) NOT IN (SELECT (s, e) FROM t)
      UNION ALL SELECT s, e - {FIT_BYTES} FROM t WHERE e - s > {FIT_BYTES}""",
    "coalesce_ranges": "WITH j AS (SELECT unnest(free_ranges) AS r FROM journal)"
    + _islands("c", "SELECT r.range_start AS s, r.range_end AS e FROM j")
    + ' SELECT s AS "start", e AS "end" FROM c',
    "delete_extents": _SPACE
    + _islands("c", "SELECT s, e FROM n UNION ALL SELECT range_start, range_end FROM x WHERE id IN (SELECT id FROM open_extents WHERE id IS NOT NULL)")
    + ' SELECT s AS "start", e AS "end" FROM c',
    "compaction_trigger": _SPACE
    + f""", q AS ({_STATS} n) SELECT ratio, ratio >= 0.3 AS due FROM (SELECT round(coalesce(free_range_count * average_fragment_size /
      nullif(total_free_space + (SELECT coalesce(sum(size), 0) FROM x), 0), 0), 9) AS ratio FROM q)""",
    "compaction_candidates": _X
    + """ SELECT id, range_end - range_start - length AS unused FROM x WHERE id NOT IN (SELECT id FROM open_extents WHERE id IS NOT NULL)
      AND range_end - range_start - length >= 4096 ORDER BY id LIMIT 10""",
    "compaction_candidates_all": _X
    + """ SELECT id, range_end - range_start - length AS unused FROM x WHERE id NOT IN (SELECT id FROM open_extents WHERE id IS NOT NULL)
      AND range_end - range_start - length >= 4096""",
    "dirty_pages": _PAGES + " SELECT page FROM p",
    "consolidate_pages": _PAGES
    + """, g AS (SELECT page, page - row_number() OVER (ORDER BY page) AS g FROM p)
      SELECT min(page) * 4096 AS "start", (max(page) + 1) * 4096 AS "end" FROM g GROUP BY g""",
    "write_ranges": _PAGES
    + """, g AS (SELECT page, page - row_number() OVER (ORDER BY page) AS g FROM p)
      SELECT min(page) * 4096 AS "start", (max(page) + 1) * 4096 AS "end" FROM g GROUP BY g""",
    "fs_health": _FREE
    + f""", q AS ({_STATS} f), a AS (SELECT coalesce(sum(range_end - range_start), 0) AS alloc, count(*) AS c, coalesce(sum(size), 0) AS used FROM x)
      SELECT total_free_space + alloc = {CAPACITY - DATA_START} AS space_accounting_valid, 16 + 64 * c + 16 * free_range_count <= 4096 AS metadata_healthy,
        CASE WHEN total_free_space > 0 THEN round(100 * (1 - largest_free_block / total_free_space), 6) ELSE 0 END AS fragmentation_percent,
        {CAPACITY - DATA_START}::BIGINT AS total_size, CAST(used AS BIGINT) AS used_space, total_free_space AS free_space,
        16 + 64 * c + 16 * free_range_count AS metadata_size, free_range_count, largest_free_block, average_fragment_size, small_fragments FROM q, a""",
    "extent_records": _X
    + """ SELECT id, coalesce(range_start, 0) AS range_start, coalesce(range_end, 0) AS range_end, length, coalesce(size, 0) AS size,
      coalesce(created_at, 0) AS created_at, coalesce(modified_at, 0) AS modified_at FROM x""",
    "range_records": _FREE + ' SELECT s AS "start", e AS "end" FROM f',
    "metadata_growth": _FREE
    + f""", q AS (SELECT 16 + 64 * (SELECT count(*) FROM x) + 16 * count(*) AS needed, max(e - s) FILTER (s = {DATA_START}) AS beside FROM f),
      o AS (SELECT needed, 2 * needed - 4096 AS more, CASE WHEN needed <= 4096 THEN 'fits' WHEN beside IS NULL THEN 'no adjacent space'
        WHEN beside >= 2 * needed - 4096 THEN 'grows' ELSE 'insufficient space' END AS outcome FROM q)
      SELECT needed, 4096 + CASE WHEN outcome = 'grows' THEN more ELSE 0 END AS metadata_bytes, CASE WHEN outcome = 'grows' THEN more ELSE 0 END AS growth, outcome FROM o""",
    "journal_entry_size": f"SELECT seq, entry_type, CAST({_SIZE} AS BIGINT) AS bytes FROM journal",
    "journal_text": """SELECT seq, entry_type, entry_time, frange_id, metadata.range_start AS range_start, metadata.modified_at AS modified_at,
      CAST(len(free_ranges) AS INTEGER) AS ranges FROM journal""",
    "journal_retention": f"""
WITH b AS (SELECT seq, CAST({_SIZE} AS BIGINT) AS bytes FROM journal),
r AS (SELECT *, CAST(coalesce(sum(CASE WHEN bytes <= {JOURNAL_BYTES} THEN bytes END) OVER (ORDER BY seq DESC ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS bytes_from_end FROM b)
SELECT seq, bytes, bytes_from_end, bytes <= {JOURNAL_BYTES} AND bytes_from_end <= {JOURNAL_BYTES} AS kept FROM r""",
    "journal_replay": _EPOCH + _REPLAY,
    "journal_free": _EPOCH.rstrip()
    + ", last AS (SELECT max(seq) AS q, max_by(free_ranges, seq) AS r FROM journal WHERE entry_type = 4 AND free_ranges IS NOT NULL)"
    + _islands(
        "c",
        """SELECT r.range_start AS s, r.range_end AS e FROM (SELECT unnest(r) AS r FROM last)
           UNION ALL SELECT base.range_start, base.range_end FROM life WHERE gone > coalesce((SELECT q FROM last), -1)""",
    )
    + ' SELECT s AS "start", e AS "end" FROM c',
    "journal_next_id": "SELECT coalesce(max(frange_id), -1) + 1 AS next_id FROM journal WHERE entry_type = 1 AND metadata IS NOT NULL",
    "journal_drift": _EPOCH.rstrip()
    + ", a AS ("
    + _REPLAY
    + "), "
    + _X.replace("WITH x AS", "b AS")
    + """
SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'not stored' WHEN a.id IS NULL THEN 'not in journal'
  WHEN a.range_start IS DISTINCT FROM b.range_start OR a.range_end IS DISTINCT FROM b.range_end THEN 'range'
  WHEN a.length IS DISTINCT FROM b.length THEN 'length' END AS problem FROM a FULL JOIN b ON a.id = b.id) WHERE problem IS NOT NULL""",
    "block_chunking": f"""
WITH d AS (SELECT doc_id, hex(text) AS h, greatest(CAST(ceil(strlen(text) / {CHUNK_BYTES}) AS INTEGER), 1) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, n, h, unnest(range(n)) AS piece FROM d)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, CASE WHEN n = 1 THEN 0 WHEN piece = 0 THEN 1 WHEN piece = n - 1 THEN 3 ELSE 2 END AS flag,
  CAST(length(substr(h, piece * {2 * CHUNK_BYTES} + 1, {2 * CHUNK_BYTES})) // 2 AS INTEGER) AS bytes,
  md5(unhex(substr(h, piece * {2 * CHUNK_BYTES} + 1, {2 * CHUNK_BYTES}))) AS digest FROM c""",
    "block_packing": """
WITH RECURSIVE b AS (SELECT DISTINCT * FROM blocks),
e AS (SELECT segment_id, block_id, unnest(entries) AS p, unnest(range(len(entries))) AS slot FROM b),
n AS (SELECT segment_id, block_id * 65536 + slot AS place, octet_length(p) AS n FROM e WHERE p IS NOT NULL),
c AS (SELECT segment_id, place, n, unnest(range(greatest((n + 4089) // 4090, 1))) AS piece FROM n),
r AS (SELECT segment_id, place, CAST(piece AS INTEGER) AS piece, CAST(least(n - piece * 4090, 4090) AS INTEGER) AS bytes,
        row_number() OVER (PARTITION BY segment_id ORDER BY place, piece) AS i FROM c),
w AS (SELECT segment_id, place, piece, bytes, i, 0::BIGINT AS block_no, 0 AS slot, bytes + 3 AS used FROM r WHERE i = 1
  UNION ALL SELECT r.segment_id, r.place, r.piece, r.bytes, r.i, CASE WHEN w.used + r.bytes + 3 > 4093 THEN w.block_no + 1 ELSE w.block_no END,
    CASE WHEN w.used + r.bytes + 3 > 4093 THEN 0 ELSE w.slot + 1 END, CASE WHEN w.used + r.bytes + 3 > 4093 THEN 0 ELSE w.used END + r.bytes + 3
  FROM w JOIN r ON r.segment_id = w.segment_id AND r.i = w.i + 1)
SELECT segment_id, place, piece, bytes, block_no, slot FROM w""",
    "block_stats": _HELD
    + """ SELECT block_id, CAST(n AS INTEGER) AS entries_held, CAST(2 + 3 * n + y AS INTEGER) AS bytes, CAST(4096 - (2 + 3 * n + y) AS INTEGER) AS remaining,
      n = 0 AS is_empty, 3 * n + y + 3 > 4093 AS is_full, num_entries = n AS count_ok FROM k""",
    "block_entries": _B + " SELECT block_id, CAST(slot AS INTEGER) AS slot, CAST(octet_length(p) AS INTEGER) AS bytes, md5(p) AS digest FROM e WHERE p IS NOT NULL",
    "block_entry_at": _B + f" SELECT block_id, md5(p) AS digest FROM e WHERE slot = {SLOT}",
    "block_offsets": """
WITH b AS (SELECT DISTINCT * FROM blocks WHERE entries IS NOT NULL),
k AS (SELECT block_id, "offsets", list_transform(list_filter(entries, lambda x: x IS NOT NULL), lambda x: octet_length(x) + 1) AS z FROM b),
o AS (SELECT block_id, "offsets" AS stored, list_transform(range(1, len(z) + 1), lambda i: CAST(list_sum(z[1:i]) AS INTEGER)) AS made FROM k)
SELECT block_id, array_to_string(made, ',') AS "offsets", stored = made AS stored_ok FROM o""",
    "block_pages": _HELD
    + """, e AS (SELECT block_id, unnest(list_filter(entries, lambda x: x IS NOT NULL)) AS p, unnest(range(n)) AS slot FROM k)
      SELECT block_id, CAST(slot AS INTEGER) AS slot, CAST(octet_length(p) AS INTEGER) AS bytes, md5(p) AS digest FROM e""",
    "segment_layout": _LAYOUT + "SELECT * FROM z",
    "segment_seek": _LAYOUT + f"SELECT segment_id, block_no, block_id FROM y WHERE block_no >= {SEEK_BLOCK}",
    "segment_remaining": _LAYOUT
    + f"SELECT segment_id, count(*) AS blocks, count(*) FILTER (block_no >= {SEEK_BLOCK}) AS blocks_remaining FROM y GROUP BY segment_id",
    "segment_stats": _HELD
    + """ SELECT segment_id, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(2 + 3 * n + y) AS BIGINT) AS bytes,
      round(100 * sum(2 + 3 * n + y) / (count(*) * 4096), 2) AS fill_percent, count(*) FILTER (num_entries IS NULL OR num_entries <> n) AS wrong_counts
      FROM k GROUP BY segment_id""",
    "stored_index_checks": """
WITH r AS (SELECT row_id, ns_offset_size, block_offset_size, coalesce(ns_offsets, []) AS o, coalesce(block_offsets, []) AS b FROM segment_index)
SELECT row_id, CAST(len(o) AS INTEGER) AS entries, CAST(len(list_distinct(list_transform(o, lambda e: e.ns))) AS INTEGER) AS namespaces,
  CAST(len(b) AS INTEGER) AS blocks, ns_offset_size = len(o) AND block_offset_size = len(b) AS size_ok,
  list_sort(list_transform(o, lambda e: e.ns)) = list_transform(o, lambda e: e.ns) AS ascending,
  CAST(len(list_filter(o, lambda e: NOT list_contains(b, e.block_offset))) AS INTEGER) AS dangling FROM r""",
}
