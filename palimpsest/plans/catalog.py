"""The registry of the library's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import kv, space, stores, training

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (kv, space, stores, training)

QUERIES: dict[str, Query] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
