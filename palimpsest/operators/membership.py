"""Membership of keys by filters that are built once and probed without the log.

Bloom filters by shards of a seeded hash: a key sets a few bits of its shard's filter, and a
probe that finds one of them unset is certainly no member. Filters are rows ``(shard, shards, seed, hashes, cells)``
to be stored beside a run; keys go to their shard as hashes, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import IDENTITY
from palimpsest.operators.index import key_hash

#: Bits and hashes of a key: about one wrong yes in a hundred. Probes that are looked up together; it bounds memory only.
BITS_PER_KEY = 10
HASHES = 7
PROBE_BATCH = 50_000

FILTERS = "shard int, shards int, seed long, hashes int, cells binary"


def _cells(h: np.ndarray, hashes: int, bits: int) -> np.ndarray:
    """The bits of each hash: two halves of a mixed hash, one added several times to the other."""
    x = h.view(np.uint64) * np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(32)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def build(keys: DataFrame, shards: int = 8, seed: int = 0, bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES) -> DataFrame:
    """Filters of the distinct ``(ns, key)`` of ``keys``; null keys are no members. No keys give no filters."""
    h = keys.filter("key IS NOT NULL").select(key_hash(seed).alias("h")).distinct().withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def run(part: pa.Table) -> pa.Table:
        own = np.asarray(part.column("h").combine_chunks())
        bits = max(64, -(-len(own) * bits_per_key // 8) * 8)
        cells = np.zeros(bits, bool)
        cells[_cells(own, hashes, bits).ravel().astype(np.int64)] = True
        row = [part.column("shard")[0].as_py(), shards, seed, hashes, np.packbits(cells).tobytes()]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["shard", "shards", "seed", "hashes", "cells"])

    return h.groupBy("shard").applyInArrow(run, FILTERS)


def may_contain(probes: DataFrame, filters: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """The distinct ``(ns, key)`` of ``probes`` that the filters, of these shards and this seed, do not rule out.

    Every member is among them; of the others about one in a hundred is.
    """
    asked = probes.filter("key IS NOT NULL").select(*IDENTITY).distinct().withColumn("h", key_hash(seed))
    asked = asked.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    width = asked.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_BATCH).alias("batches"))
    batched = (
        asked.join(F.broadcast(width), "shard").withColumn("batch", F.pmod(F.xxhash64("h"), F.col("batches")))
        .groupBy("shard", "batch").agg(F.collect_list(F.struct("ns", "key", "h")).alias("asked"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(0)[k].values
                cells = np.unpackbits(np.frombuffer(batch.column(2)[k].as_py(), dtype=np.uint8)).view(bool)
                found = cells[_cells(np.asarray(rows.field(2)), batch.column(1)[k].as_py(), len(cells)).astype(np.int64)].all(axis=1)
                yield pa.RecordBatch.from_arrays([rows.field(i).filter(pa.array(found)) for i in range(2)], names=list(IDENTITY))

    return batched.join(filters.drop("seed", "shards"), "shard").select("asked", "hashes", "cells").mapInArrow(run, "ns long, key binary")
