"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, leaks, packing, seen, spans, survivors
from palimpsest.plans.kv import CRC_SQL
from palimpsest.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.version_survivors(table(spark, folder, "version_log")).select("first_seq", "val_seq", "writer_seq")


def p1_currency(spark: SparkSession, folder: str) -> DataFrame:
    found = survivors.version_survivors(table(spark, folder, "version_log"), "learned")
    return found.select("first_seq", "n_rows", "val_seq", "val_by", "writer_seq", "writer_by")


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    found = survivors.version_records(table(spark, folder, "version_log"))
    return found.select("first_seq", "n_rows", F.col("v_ns").alias("ns"), F.hex("v_key").alias("key"), F.col("v_us").alias("us"), F.hex("val").alias("val"), "writer")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return seen.seen_before(table(spark, folder, "incoming_puts"), table(spark, folder, "version_log"))


def p2_error_rates(spark: SparkSession, folder: str) -> DataFrame:
    return seen.error_report(table(spark, folder, "incoming_puts"), table(spark, folder, "version_log"))


def p2_error_totals(spark: SparkSession, folder: str) -> DataFrame:
    return seen.error_totals(p2_error_rates(spark, folder))


def p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return packing.repack(table(spark, folder, "blocks"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(packing.repack(table(spark, folder, "blocks")))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_column(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_reparameterised(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.reparameterised_members(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    return leaks.leak_report(leaks.leaked_items(table(spark, folder, "documents"), items), items)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"))


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spans.shared_share(spans.shared_spans(docs), docs)


QUERIES = {
    "p1_found": p1_found,
    "p1_currency": p1_currency,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_error_rates": p2_error_rates,
    "p2_error_totals": p2_error_totals,
    "p5_blocks": p5_blocks,
    "p5_report": p5_report,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_reparameterised": p7_reparameterised,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_share": p8_share,
}

_VERSIONS = (
    CRC_SQL.rstrip()
    + f""",
b AS (
  SELECT seq, coalesce(ns, 0) AS ns, regexp_replace(hex(key), '(00|20)+$', '') AS key, CASE WHEN ts < {10**17} THEN ts ELSE ts // 1000 END AS us,
         val, writer, arrived_at, CASE WHEN val IS NULL THEN 0 WHEN crc = val_crc THEN 2 ELSE 1 END AS q
  FROM c WHERE key IS NOT NULL AND ts <> 0),
s AS (
  SELECT ns, key, us, min(seq) AS first_seq, count(*) AS n_rows, first(seq ORDER BY q DESC, arrived_at DESC NULLS LAST, seq DESC) AS val_seq,
         first(seq ORDER BY arrived_at DESC NULLS LAST, seq DESC) FILTER (writer <> '') AS writer_seq
  FROM b GROUP BY ns, key, us)
"""
)
# Learned precedence as :func:`palimpsest.llm.survivors.precedence` defines it, where no majorities form a circle.
_LEARNED = (
    _VERSIONS.replace("WITH tab AS", "WITH RECURSIVE tab AS", 1).rstrip()
    + f""",
d AS (SELECT *, nullif(lower(regexp_extract(CAST(val AS VARCHAR), '^([A-Za-z]+):', 1)), '') AS k FROM b),
f AS (SELECT ns, key, us, k, min(arrived_at) AS t FROM d WHERE arrived_at IS NOT NULL AND k IS NOT NULL GROUP BY ALL),
g AS (SELECT lag(k) OVER w AS before, lag(t) OVER w AS tb, k AS after, t FROM f WINDOW w AS (PARTITION BY ns, key, us ORDER BY t, k)),
n AS (SELECT before, after, count(*) AS n FROM g WHERE before IS NOT NULL AND tb < t GROUP BY ALL),
m AS (SELECT a.before, a.after, a.n, coalesce(r.n, 0) AS m FROM n a LEFT JOIN n r ON r.before = a.after AND r.after = a.before),
e AS (SELECT before, after FROM m WHERE n >= {survivors.MIN_SUPPORT} AND n > m AND n >= {survivors.MIN_SHARE} * (n + m) AND n - m >= {survivors.MIN_SIGMAS} * sqrt(n + m)),
o AS (SELECT before, after FROM e UNION SELECT o.before, e.after FROM o JOIN e ON e.before = o.after),
timed AS (SELECT ns, key, us, seq, q, k FROM d WHERE arrived_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ns, key, us ORDER BY q DESC, arrived_at DESC, seq DESC) = 1),
bare AS (SELECT ns, key, us, seq, q, k FROM d WHERE arrived_at IS NULL QUALIFY row_number() OVER (PARTITION BY ns, key, us, k ORDER BY q DESC, seq DESC) = 1),
best AS (SELECT * FROM bare QUALIFY q = max(q) OVER (PARTITION BY ns, key, us)),
after AS (SELECT b.* FROM best b JOIN timed t USING (ns, key, us) WHERE b.q = t.q AND (t.k, b.k) IN (SELECT (before, after) FROM o)),
pool AS (SELECT *, true AS preceded FROM after UNION ALL SELECT *, false FROM best WHERE (ns, key, us) NOT IN (SELECT (ns, key, us) FROM after)),
newest AS (SELECT ns, key, us, max(seq) AS seq, any_value(q) AS q, any_value(preceded) AS preceded FROM pool p
  WHERE NOT EXISTS (SELECT 1 FROM pool x JOIN o ON o.before = p.k AND o.after = x.k WHERE x.ns = p.ns AND x.key = p.key AND x.us = p.us) GROUP BY ns, key, us)
"""
)
_SPANS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
w AS (SELECT r, i, hash(substr(text, CAST(i + 1 AS BIGINT), 300)) AS h FROM (SELECT r, text, unnest(range(n - 299)) AS i FROM d)),
g AS (SELECT h FROM w GROUP BY h HAVING min(r) <> max(r)),
s AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM g)),
m AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 300 THEN 0 ELSE 1 END AS first FROM s),
k AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT any_value(doc_id) AS doc_id, min(i) AS span_start, max(i) + 300 AS span_end FROM k JOIN d USING (r) GROUP BY r, k)
"""

ORACLE: dict[str, str] = {
    "p1_found": _VERSIONS + "SELECT first_seq, val_seq, writer_seq FROM s WHERE n_rows > 1",
    "p1_records": _VERSIONS
    + """SELECT s.first_seq, s.n_rows, s.ns, s.key, s.us, hex(v.val) AS val, w.writer
FROM s JOIN b v ON v.seq = s.val_seq LEFT JOIN b w ON w.seq = s.writer_seq""",
    "p1_currency": _LEARNED
    + """SELECT s.first_seq, s.n_rows, CASE WHEN coalesce(w.preceded, false) OR t.seq IS NULL OR coalesce(w.q > t.q, false) THEN w.seq ELSE t.seq END AS val_seq,
  CASE WHEN coalesce(w.preceded, false) THEN 'precedence' ELSE 'order' END AS val_by, s.writer_seq, 'order' AS writer_by
FROM s LEFT JOIN timed t USING (ns, key, us) LEFT JOIN newest w USING (ns, key, us) WHERE s.n_rows > 1""",
    "p8_found": _SPANS + "SELECT doc_id, span_start, span_end FROM p",
    "p8_share": _SPANS
    + """SELECT doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars
FROM documents LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM p GROUP BY doc_id) USING (doc_id)""",
    "p2_error_totals": """
WITH p AS (SELECT DISTINCT coalesce(ns, 0) AS n, regexp_replace(hex(key), '(00|20)+$', '') AS k FROM incoming_puts WHERE key IS NOT NULL),
l AS (SELECT DISTINCT coalesce(ns, 0) AS n, regexp_replace(hex(key), '(00|20)+$', '') AS k FROM version_log WHERE key IS NOT NULL)
SELECT count(*) AS probes, count(l.k) AS known, CAST(0 AS BIGINT) AS missed, true AS within_bound FROM p LEFT JOIN l USING (n, k)""",
    "p2_found": """
WITH k AS (
  SELECT in_id, coalesce(ns, 0) AS n, regexp_replace(hex(key), '(00|20)+$', '') AS k FROM incoming_puts WHERE key IS NOT NULL),
f AS (SELECT *, min(in_id) OVER (PARTITION BY n, k) AS first FROM k),
l AS (SELECT DISTINCT coalesce(ns, 0) AS n, regexp_replace(hex(key), '(00|20)+$', '') AS k FROM version_log WHERE key IS NOT NULL)
SELECT in_id FROM f WHERE in_id > first OR EXISTS (SELECT 1 FROM l WHERE l.n = f.n AND l.k = f.k)
""",
}
