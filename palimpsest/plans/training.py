"""Queries on skewed keys (p3) and orphan references (p4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import orphans, skew
from palimpsest.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.heavy_namespaces(table(spark, folder, "version_log"), table(spark, folder, "segment_index"))


def p3_namespace_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The products may have 38 digits; they are written out."""
    found = skew.namespace_profile(table(spark, folder, "version_log"), table(spark, folder, "segment_index"))
    return found.select("ns", "log_rows", "index_entries", *(F.col(c).cast("string").alias(c) for c in ("pairs", "val_bytes", "blocks")))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    refs = orphans.store_references(*(table(spark, folder, t) for t in ("journal", "open_extents", "segment_index")))
    return orphans.orphans(refs, table(spark, folder, "extents"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", "ref_key", "period")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder)).withColumn("orphans", F.col("orphans").cast("long"))


QUERIES = {"p3_found": p3_found, "p3_namespace_profile": p3_namespace_profile, "p4_found": p4_found, "p4_report": p4_report}

_P4 = """
WITH parents AS (
  SELECT id, created_at, deleted_at FROM extents WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified_at DESC NULLS LAST, created_at DESC NULLS LAST,
                             (deleted_at IS NULL) DESC, deleted_at DESC NULLS LAST) = 1),
refs AS (
  SELECT 'journal' AS ref_table, seq AS ref_key, frange_id AS ref_id, entry_time * 1000000 AS at_us
  FROM journal WHERE entry_type IN (1, 2, 3) AND frange_id IS NOT NULL
  UNION ALL SELECT 'open_extents', handle_id, id, epoch_us(opened_at) FROM open_extents WHERE id IS NOT NULL
  UNION ALL SELECT 'segment_index', row_id, id, epoch_us(written_at) FROM segment_index WHERE id IS NOT NULL),
bad AS (
  SELECT ref_table, ref_key, coalesce(strftime(make_timestamp(at_us), '%Y-%m'), 'unknown') AS period,
         CASE WHEN p.id IS NULL THEN 'missing' WHEN at_us < created_at * 1000000 THEN 'created later'
              WHEN at_us > deleted_at * 1000000 THEN 'deleted before' END AS reason
  FROM refs r LEFT JOIN parents p ON p.id = r.ref_id)
"""

ORACLE = {
    "p3_found": """
WITH n AS (
  SELECT 'version_log' AS in_table, coalesce(ns, 0) AS ns, count(*) AS n FROM version_log GROUP BY ALL
  UNION ALL
  SELECT 'segment_index', coalesce(e.ns, 0), count(*) FROM (SELECT unnest(ns_offsets) AS e FROM segment_index) GROUP BY ALL)
SELECT in_table, ns FROM n QUALIFY n * 20 >= sum(n) OVER (PARTITION BY in_table)
""",
    "p3_namespace_profile": """
WITH l AS (SELECT coalesce(ns, 0) AS ns, count(*) AS n, coalesce(sum(octet_length(val)), 0) AS v FROM version_log GROUP BY ALL),
r AS (SELECT coalesce(e.ns, 0) AS ns, count(*) AS n, coalesce(sum(e.block_offset // 4096), 0) AS b
      FROM (SELECT unnest(ns_offsets) AS e FROM segment_index) GROUP BY ALL)
SELECT l.ns, l.n AS log_rows, r.n AS index_entries, CAST(l.n::HUGEINT * r.n AS VARCHAR) AS pairs,
       CAST(l.v::HUGEINT * r.n AS VARCHAR) AS val_bytes, CAST(r.b::HUGEINT * l.n AS VARCHAR) AS blocks
FROM l JOIN r ON l.ns = r.ns
""",
    "p4_found": _P4 + "SELECT ref_table, ref_key, period FROM bad WHERE reason IS NOT NULL",
    "p4_report": _P4 + "SELECT ref_table, period, reason, count(*) AS orphans FROM bad WHERE reason IS NOT NULL GROUP BY ALL",
}
