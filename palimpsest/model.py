"""The version log: schema, order and validity.

A row says that ``key`` of namespace ``ns`` got ``value`` (or was deleted) at version time
``ts``, in nanoseconds. ``seq`` is the order of arrival, ``src`` the sorted run that holds it.
Rows are ordered by namespace, then key bytes, then newest version first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.errors import InvalidRow

LOG = T.StructType(
    [
        T.StructField("ns", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("ts", T.LongType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("is_delete", T.BooleanType()),
        T.StructField("seq", T.LongType()),
        T.StructField("src", T.IntegerType()),
    ]
)
COLUMNS = LOG.names
IDENTITY = ["ns", "key"]
VERSION = ["ns", "key", "ts"]
DEFAULT_NAMESPACE = 0


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG)


def total_order() -> list[Column]:
    """Namespace, key bytes, newest first; rows of one version: latest run, then latest arrival."""
    return [F.col("ns"), F.col("key"), F.col("ts").desc(), F.col("src").desc(), F.col("seq").desc()]


def valid() -> Column:
    """Whether a row is one the model allows."""
    return F.col("ns").isNotNull() & (F.col("ns") >= 0) & F.col("key").isNotNull() & F.col("ts").isNotNull() & (F.col("ts") > 0)


def conform(rows: DataFrame, strict: bool = False) -> DataFrame:
    """``rows`` in the log's columns and types.

    Missing ``ns`` is namespace 0, missing ``is_delete`` false, missing ``value`` null, missing ``seq``
    and ``src`` 0; a deleted row's value is null. Extra columns are dropped. Rows the model does not
    allow are dropped, or with ``strict`` raise :class:`InvalidRow` at once.
    """
    have = set(rows.columns)
    defaults = {"ns": F.lit(DEFAULT_NAMESPACE), "value": F.lit(None), "is_delete": F.lit(False), "seq": F.lit(0), "src": F.lit(0)}
    cols = {f.name: (F.col(f.name) if f.name in have else defaults[f.name]).cast(f.dataType) for f in LOG if f.name in have or f.name in defaults}
    cols["is_delete"] = F.coalesce(cols["is_delete"], F.lit(False))
    out = rows.select(*(c.alias(n) for n, c in cols.items()))
    out = out.withColumn("value", F.when(~F.col("is_delete"), F.col("value")))
    if strict and not out.filter(~F.coalesce(valid(), F.lit(False))).isEmpty():
        raise InvalidRow("namespace must be at least 0, version time above 0, key not null")
    return out.filter(valid()).select(*COLUMNS)
