"""A durable store of versions: sorted runs in Parquet under an atomically advanced manifest.

Single puts gather in the driver until they are synced; batches of any size are tables and go
straight to a run of their own. A manifest names the runs that exist; the next one is written
aside and renamed to the next number, which fails if that exists, so of two writers the second
fails and nothing is half seen. That asks for a file system whose rename is atomic and refuses
an existing target, as HDFS and local ones do. Reads are plans over all runs and the unsynced rows.

Once there are many runs, the smallest neighbouring ones are merged. Merging keeps every
version; history is dropped only by :meth:`Store.compact` with a horizon, or without one of
all that is no newest version. Files of merged runs stay for a while, for readers whose plans
name them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.clock import Clock, HybridClock, stamp
from palimpsest.errors import CapacityExceeded, EngineError, InvalidHeader, InvalidRow, RunFrozen, StaleManifest
from palimpsest.functions.bounds import Bound
from palimpsest.functions.codecs import NS_BYTES, TS_BYTES
from palimpsest.functions.numbering import with_position
from palimpsest.model import COLUMNS, LOG, empty_log
from palimpsest.operators import merge as merging
from palimpsest.operators import reads, writes

FORMAT = 1


class Files:
    """Small files and renames on whatever file system a path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")

    def _at(self, name: str) -> tuple[Any, Any]:
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self._conf), p

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet, whole or not at all; whether it was written."""
        fs, target = self._at(name)
        _, aside = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self._conf)
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            files.rename(aside, target, options)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(target) and ("AlreadyExists" in str(e) or "already exists" in str(e)):
                return False
            raise
        return True

    def read(self, name: str) -> str:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)


class Manifest:
    """Numbered JSON states under one folder; the highest number holds."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder, self.number = files, folder, 0

    def load(self) -> dict | None:
        """The newest state that can be read; one that was torn by a crash is passed over."""
        names = [n for n in self.files.names(self.folder) if n.endswith(".json")]
        for name in reversed(names):
            try:
                state = json.loads(self.files.read(f"{self.folder}/{name}"))
            except ValueError:
                continue
            if state.get("format") != FORMAT:
                raise InvalidHeader(f"format {state.get('format')!r}")
            self.number = int(names[-1][:-5])
            return state
        if names:
            raise InvalidHeader("no state can be read")
        return None

    def commit(self, state: dict) -> None:
        if not self.files.create(f"{self.folder}/{self.number + 1:012d}.json", json.dumps(state | {"format": FORMAT})):
            raise StaleManifest(f"state {self.number + 1} exists already")
        self.number += 1
        for old in [n for n in self.files.names(self.folder) if n.endswith(".json")][:-3]:
            self.files.delete(f"{self.folder}/{old}")


@dataclass
class StoreOptions:
    """``run_bytes`` limits the unsynced rows (as :func:`palimpsest.functions.codecs.run_bytes` counts);
    with ``rotate`` a full run is synced and a new one begun, else a put that does not fit raises.
    From ``max_runs`` runs on, writing merges the smallest neighbouring ones, all versions kept. A run
    that was replaced stays on disk for ``grace_seconds``. A file of a run holds
    ``records_per_file`` rows at most (0: no limit), in row groups of ``block_bytes``, each with its statistics."""

    clock: Clock = field(default_factory=HybridClock)
    run_bytes: int = 512 << 20
    max_runs: int = 16
    rotate: bool = True
    records_per_file: int = 0
    grace_seconds: float = 3600.0
    block_bytes: int = 128 << 20


class Store:
    """Versions of keys in namespaces; the last write of a key wins, by version time."""

    def __init__(self, spark: SparkSession, path: str, options: StoreOptions | None = None):
        self.spark, self.options = spark, options or StoreOptions()
        self.path = path.rstrip("/")
        self._files = Files(spark, self.path)
        self._manifest = Manifest(self._files, "manifest")
        state = self._manifest.load() or {"runs": [], "next_seq": 1, "next_src": 0, "high_water": 0, "batches": {}, "replaced": []}
        self._state = state
        clock = self.options.clock
        if isinstance(clock, HybridClock) and clock.high_water < state["high_water"]:
            self.options.clock = HybridClock(state["high_water"], clock._wall)
        self._pending: list[tuple] = []
        self._pending_bytes = 0
        self._frozen = self._closed = False
        self._cached: tuple[list[str], DataFrame] | None = None

    # writes

    def time(self) -> int:
        """A version time later than all this store gave before."""
        return self.options.clock.time()

    def put(self, key: bytes, value: bytes) -> int:
        return self.put_ns(0, key, value)

    def put_ns(self, ns: int, key: bytes, value: bytes) -> int:
        """Write a version now; its version time."""
        ts = self.time()
        self.batch([("put_ns", ns, key, ts, value)])
        return ts

    def delete(self, key: bytes) -> int:
        return self.delete_ns(0, key)

    def delete_ns(self, ns: int, key: bytes) -> int:
        ts = self.time()
        self.batch([("delete_ns", ns, key, ts, None)])
        return ts

    def batch(self, ops: Iterable[tuple[str, int | None, bytes, int, bytes | None]], partial: bool = False) -> int:
        """Apply ``(op, ns, key, ts, value)`` in order; how many were taken.

        The batch is taken whole or, if a row is invalid or does not fit, not at all. With ``partial``
        the rows before the first that does not fit stay. 'put' and 'delete' go to namespace 0.
        """
        self._writable()
        rows, size = [], self._pending_bytes
        full = False
        for op, ns, key, ts, value in ops:
            if op not in (writes.PUT, writes.DELETE, writes.PUT_NS, writes.DELETE_NS):
                raise InvalidRow(f"operation {op!r}")
            ns = 0 if op in (writes.PUT, writes.DELETE) or ns is None else ns
            gone = op in (writes.DELETE, writes.DELETE_NS)
            if ns < 0 or key is None or ts is None or ts <= 0:
                raise InvalidRow(f"namespace {ns}, key {key!r}, version time {ts}")
            size += 3 * (len(key) + NS_BYTES + TS_BYTES) + NS_BYTES + (0 if gone or value is None else len(value)) + TS_BYTES
            if size > self.options.run_bytes and not self.options.rotate:
                full = True
                break
            rows.append((ns, bytearray(key), ts, None if gone or value is None else bytearray(value), gone))
            last = size
        if full and not partial:
            raise CapacityExceeded(f"{size} bytes in a run of {self.options.run_bytes}")
        seq = self._state["next_seq"]
        self._pending += [(*r, seq + i) for i, r in enumerate(rows)]
        self._state["next_seq"] = seq + len(rows)
        if rows:
            self._pending_bytes = last
        if self._pending_bytes > self.options.run_bytes:
            self.sync()
        return len(rows)

    def write_table(self, rows: DataFrame, batch_id: str | None = None, order: str | None = None) -> bool:
        """Write a table of operations ``(op, ns, key, ts, value)`` or of log rows as a run of its own.

        Without ``ts`` the rows are stamped by the clock in ``order``. A ``batch_id`` is written once:
        a second call with it does nothing and returns False. Ids that are a name and a number,
        ``name-7``, must be given in ascending order, as a stream does; of them the last number is kept.
        """
        self._writable()
        stream, number = _stream_batch(batch_id)
        last = self._state["batches"].get(stream)
        if stream is not None and last is not None and (number is None or number <= last):
            return False
        if "ts" not in rows.columns:
            clock = self.options.clock
            base = clock.reserve(rows.count()) if isinstance(clock, HybridClock) else clock.time()
            rows = stamp(rows, base, [order or "key"])
        by = order or ("seq" if "seq" in rows.columns else "ts")
        rows = stamp_seq(rows, by, self._state["next_seq"])
        log = writes.normalise_batch(rows) if "op" in rows.columns else writes.conform(rows)
        self._state["next_seq"] = max(self._state["next_seq"], self._add_run(log) + 1)
        if stream is not None:
            self._state["batches"][stream] = True if number is None else number
        self._commit()
        self._merge_small()
        return True

    def freeze(self) -> None:
        """Refuse writes until :meth:`new_run`."""
        self._frozen = True

    def new_run(self) -> int:
        """Sync the current run and begin another; its number."""
        self.sync()
        self._frozen = False
        return self._state["next_src"]

    def _writable(self) -> None:
        if self._closed:
            raise EngineError("the store is closed")
        if self._frozen:
            raise RunFrozen("the run is frozen")

    # reads

    def _stored(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/{r['path']}" for r in runs)) if runs else empty_log(self.spark)

    def log(self) -> DataFrame:
        """All versions, synced or not."""
        runs = [r["path"] for r in self._state["runs"]]
        stored = self._cached[1] if self._cached is not None and self._cached[0] == runs else self._stored(self._state["runs"])
        return stored.unionByName(self._unsynced()) if self._pending else stored

    def cache(self) -> None:
        """Keep the synced runs' rows in the executors' memory, spilling to disk, until the runs change."""
        self.clear_cache()
        runs = [r["path"] for r in self._state["runs"]]
        if runs:
            self._cached = (runs, self._stored(self._state["runs"]).persist())

    def clear_cache(self) -> None:
        if self._cached is not None:
            self._cached[1].unpersist()
            self._cached = None

    def _unsynced(self) -> DataFrame:
        src = self._state["next_src"]
        return self.spark.createDataFrame([(*r, src) for r in self._pending], LOG)

    def get(self, key: bytes, raw: bool = False) -> bytes | None:
        return self.get_ns(0, key, raw)

    def get_ns(self, ns: int, key: bytes, raw: bool = False) -> bytes | None:
        """The newest value, or None if the key is missing or deleted; ``raw`` gives empty bytes for a
        deleted key."""
        rows = self.log().filter((F.col("ns") == ns) & (F.col("key") == F.lit(bytearray(key))))
        found = reads.latest(rows).first()
        if found is None:
            return None
        if found["is_delete"]:
            return b"" if raw else None
        return None if found["value"] is None else bytes(found["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return reads.multi_get(self.log(), keys)

    def scan(self, lo: Bound | None = None, hi: Bound | None = None) -> DataFrame:
        """All versions within the bounds, in order."""
        return reads.scan(self.log(), lo, hi)

    def merge(self, lo: Bound | None = None, hi: Bound | None = None) -> DataFrame:
        return merging.merge(self.log(), lo, hi)

    def live(self) -> DataFrame:
        return reads.live(self.log())

    def as_of(self, ts: int) -> DataFrame:
        return reads.as_of(self.log(), ts)

    @property
    def runs(self) -> list[dict]:
        return list(self._state["runs"])

    @property
    def run_bytes(self) -> int:
        """Bytes of the unsynced rows, as the run's limit counts them."""
        return self._pending_bytes

    # durability

    def sync(self) -> None:
        """Make all writes durable."""
        if self._pending:
            self._flush()
            self._commit()
        self._merge_small()

    def _flush(self) -> None:
        if self._pending:
            self._add_run(self._unsynced())
            self._pending, self._pending_bytes = [], 0

    def _merge_small(self) -> None:
        """While there are ``max_runs`` runs or more, merge half of them: those neighbours in the order of runs
        that hold the fewest rows. A large run is so rewritten only after as much was written again."""
        most = max(self.options.max_runs, 2)
        while len(self._state["runs"]) >= most:
            runs, n = self._state["runs"], most // 2 + 1
            at = min(range(len(runs) - n + 1), key=lambda i: sum(r["rows"] for r in runs[i : i + n]))
            self._replace(at, at + n, self._stored(runs[at : at + n]))

    def _replace(self, first: int, last: int, rows: DataFrame) -> None:
        """Put one run of ``rows`` in the place of the runs from ``first`` to ``last``; their files stay for a while."""
        runs, now = self._state["runs"], time.time()
        self._add_run(rows, place=(first, last))
        self._state["replaced"] = [*self._state.get("replaced", []), *({"path": r["path"], "at": now} for r in runs[first:last])]
        self._commit()
        self._sweep()

    def _sweep(self) -> None:
        """Delete the files of runs that were replaced long enough ago."""
        limit = time.time() - self.options.grace_seconds
        gone = [r for r in self._state["replaced"] if r["at"] <= limit]
        for r in gone:
            self._files.delete(r["path"])
            self._files.delete(f"index/{r['path'][len('runs/') :]}")
        self._state["replaced"] = [r for r in self._state["replaced"] if r["at"] > limit]

    def compact(self, keep_history: bool = False, horizon: int | None = None) -> None:
        """Rewrite all runs as one.

        With ``keep_history`` all versions stay. Otherwise, of the versions at or before ``horizon`` (default:
        of all), only each key's newest stays, and not that either if it is a tombstone: what was read
        as of the horizon or later is read still, what was read as of earlier times is not.
        """
        self._flush()
        if not self._state["runs"]:
            return
        rows = self._stored(self._state["runs"])
        if not keep_history:
            old, new = (rows, None) if horizon is None else (rows.filter(F.col("ts") <= horizon), rows.filter(F.col("ts") > horizon))
            rows = merging.compact(old, drop_tombstones=True)
            rows = rows if new is None else rows.unionByName(new)
        self._replace(0, len(self._state["runs"]), rows)

    def close(self) -> None:
        """Sync and refuse all further writes."""
        if not self._closed:
            self.sync()
            self.clear_cache()
            self._closed = True

    def _add_run(self, rows: DataFrame, place: tuple[int, int] | None = None) -> int:
        """Write a run, at the end or in ``place`` of others; the largest sequence number in it, or 0."""
        runs = self._state["runs"]
        first, last = place or (len(runs), len(runs))
        src = self._state["next_src"] if place is None else runs[last - 1]["src"]
        name = f"runs/{src:08d}-{uuid.uuid4().hex}"
        seen = Observation()
        laid_out = merging.sorted_run(rows.withColumn("src", F.lit(src)).select(*COLUMNS))
        # beyond the sort, which looks at its input twice
        writer = laid_out.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("seq").alias("seq")).write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.block.size", self.options.block_bytes)
        if self.options.records_per_file:
            writer = writer.option("maxRecordsPerFile", self.options.records_per_file)
        writer.parquet(f"{self.path}/{name}")
        self._write_index(name)
        self._state["runs"] = [*runs[:first], {"src": src, "path": name, "rows": seen.get["rows"]}, *runs[last:]]
        if place is None:
            self._state["next_src"] = src + 1
        return seen.get["seq"] or 0

    def _write_index(self, name: str) -> None:
        """Beside a run, of each of its files the namespaces with their first and last key: ``ns, file, first_key, last_key, rows``."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/{name}").select("ns", "key", F.input_file_name().alias("file"))
        ends = F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("rows")
        rows.groupBy("ns", "file").agg(*ends).coalesce(1).write.parquet(f"{self.path}/index/{name[len('runs/') :]}")

    def index(self) -> DataFrame:
        """The indexes written with the runs: ``ns, file, first_key, last_key, rows``."""
        names = [f"{self.path}/index/{r['path'][len('runs/') :]}" for r in self._state["runs"]]
        schema = "ns long, file string, first_key binary, last_key binary, rows long"
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _commit(self) -> None:
        clock = self.options.clock
        if isinstance(clock, HybridClock):
            self._state["high_water"] = max(self._state["high_water"], clock.high_water)
        self._manifest.commit(self._state)


def stamp_seq(rows: DataFrame, order: str, first: int) -> DataFrame:
    """``rows`` with ``seq`` = ``first`` + place in ``order``."""
    return with_position(rows.withColumn("_by", F.col(order)).drop("seq"), [F.col("_by")], "seq", first=first).drop("_by")


def _stream_batch(batch_id: str | None) -> tuple[str | None, int | None]:
    """A batch id's stream and number; an id without a number is a stream of one."""
    if batch_id is None:
        return None, None
    name, _, number = batch_id.rpartition("-")
    return (name, int(number)) if name and number.isdigit() else (batch_id, None)
