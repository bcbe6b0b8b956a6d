"""Has a key occurred before? Membership among sealed batches by fingerprint filters.

The log is cut by arrival into a few generations of sealed batches of about equal size. For
every generation and shard of the key hash an immutable filter is built by peeling: each key
owns three cells, one in each third of the table; cells that a single key owns are peeled off
round by round, and in reverse order each key's cell gets the value that makes the xor of its
three cells the key's 16-bit fingerprint. A filter takes about 2.5 bytes a key, so the whole
log's filters stand for it where the keys themselves would not fit. Filters are saved and
loaded, and a further batch is appended as a generation of its own; the log is not read again.

Incoming keys go to their shard in bounded batches and are probed against the shard's
filter of every generation. A miss is certain. A hit is wrong with a chance of 2^-16 per
generation (of 16 bits); over all generations that compounds to 1 - (1 - 2^-16)^n, which is
reported beside the measured rate. Where the log is given too, the few hits are confirmed
against its keys. Earlier records of the incoming batch itself are kept exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.keys import namespace, plain_key
from palimpsest.session import durable

#: Generations of the log, and keys that a filter holds about; the number of shards follows.
GENERATIONS = 8
FILTER_KEYS = 50_000
PROBE_BATCH = 50_000
FINGERPRINT_BITS = 16

_U = np.uint64


def _scramble(h: np.ndarray, seed: int) -> np.ndarray:
    x = h.view(np.uint64) + _U((seed * 0x9E3779B97F4A7C15) % 2**64)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _cells(h: np.ndarray, seed: int, third: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells of each key, one per third of the table, and the fingerprints."""
    x = _scramble(h, seed)
    cells = np.empty((len(h), 3), dtype=np.int64)
    for k in range(3):
        part = (x >> _U(21 * k)) & _U(0x1FFFFF)
        if third > 1 << 17:
            part = _scramble(x.view(np.int64), k + 1) & _U(0xFFFFFFFF)
            cells[:, k] = ((part * _U(third)) >> _U(32)).astype(np.int64) + k * third
        else:
            cells[:, k] = ((part * _U(third)) >> _U(21)).astype(np.int64) + k * third
    marks = (_scramble(x.view(np.int64), 77) & _U((1 << bits) - 1)).astype(np.uint16)
    return cells, marks


def build_filter(hashes: np.ndarray, bits: int = FINGERPRINT_BITS) -> tuple[int, int, bytes]:
    """``(seed, third, table)`` of a filter of distinct 64-bit hashes."""
    third = int(len(hashes) * 1.27 / 3) + 11
    seed = 0
    while True:
        seed += 1
        cells, marks = _cells(hashes, seed, third, bits)
        owners = np.bincount(cells.ravel(), minlength=3 * third)
        keys = np.zeros(3 * third, dtype=np.int64)
        for k in range(3):
            np.bitwise_xor.at(keys, cells[:, k], np.arange(len(hashes)))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        left = len(hashes)
        single = np.flatnonzero(owners == 1)
        while len(single):
            own, first = np.unique(keys[single], return_index=True)
            rounds.append((own, single[first]))
            left -= len(own)
            touched = cells[own].ravel()
            np.subtract.at(owners, touched, 1)
            np.bitwise_xor.at(keys, touched, np.repeat(own, 3))
            touched = np.unique(touched)
            single = touched[owners[touched] == 1]
        if not left:
            break
    table = np.zeros(3 * third, dtype=np.uint16)
    for own, at in reversed(rounds):
        c = cells[own]
        table[at] = 0
        table[at] = marks[own] ^ table[c[:, 0]] ^ table[c[:, 1]] ^ table[c[:, 2]]
    return seed, third, table.tobytes()


def probe_filter(hashes: np.ndarray, seed: int, third: int, table: bytes, bits: int = FINGERPRINT_BITS) -> np.ndarray:
    cells, marks = _cells(hashes, seed, third, bits)
    t = np.frombuffer(table, dtype=np.uint16)
    return (t[cells[:, 0]] ^ t[cells[:, 1]] ^ t[cells[:, 2]]) == marks


def _keyed(rows: DataFrame, *more: Column, ns: str = "ns", key: str = "key") -> DataFrame:
    """Rows with a key as ``(ns, key, h)`` and ``more``."""
    flat = rows.select(namespace(F.col(ns)).alias("ns"), plain_key(F.col(key)).alias("key"), *more).filter("key IS NOT NULL")
    return flat.withColumn("h", F.xxhash64("ns", "key"))


_FILTERS = "gen int, shard int, shards int, bits int, seed int, third int, n long, cells binary"


class SealedBatches:
    """The filters of a log, generation by generation.

    ``order`` is the bigint column of arrival by which the log is cut into generations, at about equal
    numbers of rows however the values lie; a null order is in the first one. The number of shards
    follows from the first log and stays what it is, so filters of later generations may be larger.
    """

    def __init__(
        self, log: DataFrame, order: str = "seq", generations: int = GENERATIONS, filter_keys: int = FILTER_KEYS, bits: int = FINGERPRINT_BITS
    ):
        self.bits = bits
        at = F.array(*(F.lit(i / generations) for i in range(1, generations)))
        cuts, n = log.agg(F.percentile_approx(order, at, 10_000) if generations > 1 else F.lit(None), F.count(F.lit(1))).first()
        self.shards = max(1, -(-n // (generations * filter_keys)))
        gen = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
        self.keys = _keyed(log, gen.alias("gen"))
        self.filters = self._build(self.keys)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SealedBatches:
        """What :meth:`save` and :meth:`append` wrote."""
        sealed = cls.__new__(cls)
        sealed.keys, sealed.filters = None, spark.read.schema(_FILTERS).parquet(path)
        sealed.shards, sealed.bits = sealed.filters.select("shards", "bits").first() or (1, FINGERPRINT_BITS)
        return sealed

    def save(self, path: str) -> SealedBatches:
        """Write the filters to ``path``, which must not exist, and use them from there."""
        self.filters.write.parquet(path)
        return self.load(self.filters.sparkSession, path)

    def append(self, batch: DataFrame, path: str) -> SealedBatches:
        """Seal ``batch`` (``ns, key``) as the next generation beside the filters saved at ``path``; only
        the batch is read."""
        last = self.filters.agg(F.max("gen")).first()[0]
        gen = F.lit(0 if last is None else last + 1).alias("gen")
        self._build(_keyed(batch, gen)).write.mode("append").parquet(path)
        return self.load(batch.sparkSession, path)

    def shard(self) -> Column:
        return F.pmod(F.shiftright("h", 7), F.lit(self.shards)).cast("int")

    def _build(self, keys: DataFrame) -> DataFrame:
        bits, shards = self.bits, self.shards

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            h = np.unique(pdf["h"].to_numpy(dtype=np.int64))
            seed, third, cells = build_filter(h, bits)
            gen, shard = pdf["gen"].iloc[0], pdf["shard"].iloc[0]
            return pd.DataFrame({"gen": [gen], "shard": [shard], "shards": [shards], "bits": [bits], "seed": [seed], "third": [third], "n": [len(h)], "cells": [cells]})

        distinct = keys.select("gen", "h").distinct().withColumn("shard", self.shard())
        return distinct.groupBy("shard", "gen").applyInPandas(build, _FILTERS)

    def probe(self, hashes: DataFrame) -> DataFrame:
        """``(h, gen)``: the generations whose filter claims to hold each distinct ``h`` of ``hashes``."""
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    h = np.asarray(batch.column(0)[k].values)
                    gens, hits = [], []
                    for f in batch.column(1)[k].as_py():
                        hit = h[probe_filter(h, f["seed"], f["third"], f["cells"], bits)]
                        hits.append(hit)
                        gens.append(np.full(len(hit), f["gen"], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hits)), pa.array(np.concatenate(gens))], names=["h", "gen"])

        hashes = hashes.withColumn("shard", self.shard())
        width = hashes.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_BATCH).alias("batches"))
        batched = (
            hashes.join(width, "shard")
            .withColumn("batch", F.pmod(F.xxhash64("h"), F.col("batches")))
            .groupBy("shard", "batch")
            .agg(F.collect_list("h").alias("hashes"))
        )
        stacks = self.filters.groupBy("shard").agg(F.collect_list(F.struct("gen", "seed", "third", "cells")).alias("filters"))
        return batched.join(stacks, "shard").select("hashes", "filters").mapInArrow(run, "h long, gen int")


def _confirmed(candidates: DataFrame, log_keys: DataFrame) -> DataFrame:
    """The rows ``(h, ns, key)`` of ``candidates`` whose very key the log has.

    A key's log rows are one per task before they are moved.
    """
    return candidates.join(log_keys.select("h", "ns", "key").distinct(), ["h", "ns", "key"], "left_semi")


def seen_before(
    incoming: DataFrame, log: DataFrame | None = None, id_col: str = "in_id", ns: str = "ns", key: str = "key", order: str = "seq",
    sealed: SealedBatches | None = None,
) -> DataFrame:
    """``(id_col)``: incoming records whose key occurs before, or under a smaller id in ``incoming``.

    Before is in ``log``, of which filters are built here unless ``sealed`` has them; hits are confirmed,
    so the answer is exact. Without ``log`` the filters of ``sealed`` decide alone, at their error rate
    (see :func:`error_report`), and nothing but them is read. A key is its namespace (null is 0) and its
    bytes without trailing 0x00 and 0x20. Records with a null key are never seen, nor is a record without
    an id reported. Records that share an id are not earlier than one another. Empty tables have no keys.
    Other columns are not read.
    """
    if log is None and sealed is None:
        raise ValueError("a log or sealed batches must be given")
    records = _keyed(incoming, F.col(id_col).alias("id"), ns=ns, key=key).filter("id IS NOT NULL")
    same = ["h", "ns", "key"]
    states = records.groupBy(*same).agg(F.min("id").alias("id"))
    sealed = sealed or SealedBatches(log, order)
    hits = sealed.probe(states.select("h").distinct()).select("h").distinct()
    known = states.join(hits, "h", "left_semi").select(*same)
    if log is not None:
        known = _confirmed(known, _keyed(log))
    # of every new key the first record alone is not seen: told by its id, so no key's records meet in one place
    first = states.join(known, same, "left_anti")
    return records.join(first, ["id", *same], "left_anti").select(F.col("id").alias(id_col))


def error_report(incoming: DataFrame, log: DataFrame, order: str = "seq", bits: int = FINGERPRINT_BITS) -> DataFrame:
    """Per generation, and compounded over all of them as generation -1: keys and bits per key held,
    distinct keys probed, hits, hits that were wrong, keys that were missed (there are none), and the
    expected and the measured rate of wrong hits among the probes that the generation lacks.

    ``(generation, keys, bits_per_key, probes, hits, wrong_hits, missed, expected_rate, measured_rate)``.
    """
    sealed = SealedBatches(log, order, bits=bits)
    filters = sealed.filters = durable(sealed.filters)
    probed = _keyed(incoming).select("h").distinct()
    true = sealed.keys.select("h", "gen").distinct().join(probed, "h", "left_semi").withColumn("true", F.lit(1))
    found = durable(sealed.probe(probed).withColumn("hit", F.lit(1)).join(true, ["h", "gen"], "full_outer"))
    aggs = [
        F.count("hit").alias("hits"), F.count_if(F.col("true").isNull()).alias("wrong_hits"), F.count("true").alias("true"), F.count_if(F.col("hit").isNull()).alias("missed"),
    ]
    per_gen = found.groupBy("gen").agg(*aggs)
    over_all = found.groupBy("h").agg(F.max("hit").alias("hit"), F.max("true").alias("true")).agg(*aggs).withColumn("gen", F.lit(-1))
    size = filters.groupBy("gen").agg(F.sum("n").alias("keys"), F.sum(F.octet_length("cells") * 8).alias("bits"))
    rate = 2.0**-bits
    total = size.agg(F.lit(-1).alias("gen"), F.sum("keys").alias("keys"), F.sum("bits").alias("bits"), F.count("*").alias("g")).withColumn(
        "rate", 1 - F.pow(F.lit(1 - rate), F.col("g"))
    )
    sizes = size.withColumn("rate", F.lit(rate)).unionByName(total.drop("g"))
    n = probed.agg(F.count("*").alias("probes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        sizes.join(per_gen.unionByName(over_all), "gen", "left")
        .crossJoin(F.broadcast(n))
        .select(
            F.col("gen").alias("generation"), zero("keys").alias("keys"), F.round(F.col("bits") / F.col("keys"), 2).alias("bits_per_key"), "probes",
            zero("hits").alias("hits"), zero("wrong_hits").alias("wrong_hits"), zero("missed").alias("missed"), F.col("rate").alias("expected_rate"),
            F.try_divide(zero("wrong_hits"), F.col("probes") - zero("true")).alias("measured_rate"),
        )
    )


def error_totals(report: DataFrame, sigmas: int = 6) -> DataFrame:
    """Of :func:`error_report` over all generations ``(probes, known, missed, within_bound)``: distinct keys probed, how
    many of them the log has, how many of those were missed, and whether the wrong hits are no more than the
    expected rate explains within ``sigmas`` standard deviations."""
    lacking = F.col("probes") - (F.col("hits") - F.col("wrong_hits")) - F.col("missed")
    expected = lacking * F.col("expected_rate")
    return report.filter("generation = -1").select(
        "probes", (F.col("hits") - F.col("wrong_hits") + F.col("missed")).alias("known"), "missed",
        (F.col("wrong_hits") <= F.ceil(expected + sigmas * F.sqrt(expected))).alias("within_bound"),
    )
