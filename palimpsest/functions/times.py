"""Times that do not depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_micros(rows: DataFrame, column: str) -> Column:
    """Microseconds since the epoch of a timestamp column; one without a zone is in UTC, whatever the
    session's zone."""
    c = F.col(column)
    if rows.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    since = c - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    whole = sum(F.extract(F.lit(name), since).cast("long") * n for name, n in (("DAY", 86_400_000_000), ("HOUR", 3_600_000_000), ("MINUTE", 60_000_000)))
    return whole + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


def utc_month(micros: str) -> Column:
    """``'YYYY-MM'`` in UTC of a column of microseconds since the epoch."""
    day = F.expr(f"cast((`{micros}` - pmod(`{micros}`, 86400000000)) div 86400000000 as int)")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM")
