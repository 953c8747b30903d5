"""A version store of Parquet generations under one folder, with a manifest as the point of commit.

    <path>/manifest-<n>.json      one per commit; the highest n counts, the last KEPT stay
    <path>/staging/<id>           a batch while it is numbered
    <path>/wal/<id>               batches not flushed yet
    <path>/level=0|1/<id>         flushed and compacted generations, ranged and sorted by key

A generation counts only if the manifest names it. A commit writes the generation, checks that no newer manifest
than its own is there, writes the next one with a create that fails if it exists, checks again, and only then removes
what is no longer named. So a writer that is behind, by however many commits, is refused (Conflict), what it wrote
is removed, and it removes nothing else; refresh() brings it up to date. All file access goes through Hadoop's file
systems, so the folder can be in any store; the create must be atomic there, as in HDFS.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.keys import sort_key
from ..operators import compaction, reads, stats
from ..operators.writes import BATCH, Batch, numbered, sequenced, validate
from ..options import Options
from ..schema import DELETE, LOG


#: Manifests that stay, so that a number is not free again while a slow writer might still use it.
KEPT = 100
log = logging.getLogger(__name__)


class Conflict(RuntimeError):
    """Another writer's commit exists."""


class Files:
    """Hadoop file access for one folder."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.io = jvm.org.apache.commons.io.IOUtils

    def names(self) -> list[str]:
        top = self.path(self.root)
        return [s.getPath().getName() for s in self.fs.listStatus(top)] if self.fs.exists(top) else []

    def read(self, name: str) -> str:
        with_stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(self.io.toByteArray(with_stream)).decode()
        finally:
            with_stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; fails if there is one."""
        out = self.fs.create(self.path(f"{self.root}/{name}"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


class Cache:
    """The newest versions of keys that were read last, absent ones too. Counters outlive what is dropped."""

    def __init__(self, entries: int):
        self.entries, self.hits, self.misses = entries, 0, 0
        self.held: OrderedDict[str, tuple | None] = OrderedDict()

    def get(self, key: str) -> tuple[bool, tuple | None]:
        found = key in self.held
        self.hits, self.misses = self.hits + found, self.misses + (not found)
        if found:
            self.held.move_to_end(key)
        return found, self.held.get(key)

    def put(self, key: str, version: tuple | None) -> None:
        self.held[key] = version
        self.held.move_to_end(key)
        if len(self.held) > self.entries:
            self.held.popitem(last=False)

    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class VersionStore:
    """Writes, flushes, compactions and the cleanup take turns; a reader may use another handle."""

    def __init__(self, spark: SparkSession, path: str, clock=None, options: Options | None = None):
        self.spark, self.files, self.options = spark, Files(spark, path), options or Options()
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.counters = dict.fromkeys(("writes", "reads", "deletes", "scans", "flushes", "compactions", "compaction_input", "backpressure", "slow_reads", "slow_scans"), 0)
        self.cache, self.turn = Cache(self.options.cache_entries), threading.RLock()
        self.cleanup: threading.Thread | None = None
        self.ended, self.closed = threading.Event(), False
        self.refresh()

    def _newest(self) -> int:
        return max((int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json")), default=-1)

    def refresh(self) -> None:
        """Take up the newest commit, whoever made it."""
        with self.turn:
            self.number, self.manifest = self._newest(), {"nextFileId": 1, "lastFlushedSequence": 0, "lastSequence": 0, "files": [], "wal": []}
            if self.number >= 0:
                self.manifest |= json.loads(self.files.read(f"manifest-{self.number}.json"))
            self.cache.held.clear()

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")

    def _commit(self, manifest: dict, made: str | None) -> None:
        """Make this the newest manifest. made: the folder that the commit adds, removed if it is refused."""
        name = f"manifest-{self.number + 1}.json"
        try:
            if self._newest() != self.number:
                raise Conflict("another writer's commit exists; refresh and try again")
            self.files.create(name, json.dumps(manifest, indent=2))
            if self._newest() != self.number + 1:  # it came so late that its number was free again
                self.files.remove(name)
                raise Conflict("other writers' commits exist; refresh and try again")
        except Exception:
            if made:
                self.files.remove(made)
            raise
        old = {g["path"] for g in self.manifest["files"] + self.manifest["wal"]}
        self.number, self.manifest = self.number + 1, manifest
        for path in old - {g["path"] for g in manifest["files"] + manifest["wal"]}:
            self.files.remove(path)
        if self.number >= KEPT:
            self.files.remove(f"manifest-{self.number - KEPT}.json")

    def _read(self, generations: list[dict]) -> DataFrame:
        if not generations:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.files.root}/{g['path']}" for g in generations])

    def log(self) -> DataFrame:
        """All committed versions; a missing generation is an error."""
        self._open()
        return self._read(self.manifest["files"] + self.manifest["wal"])

    def _level0(self) -> int:
        return sum(g["level"] == 0 for g in self.manifest["files"])

    def _timed(self, what: str, began: float) -> None:
        took = (time.monotonic() - began) * 1000
        if took >= self.options.slow_ms:
            self.counters[what] += 1
            log.warning("%s: %.0f ms", what.replace("_", " "), took)

    def snapshot(self) -> int:
        self._open()
        return self.manifest["lastSequence"]

    def _backpressure(self) -> None:
        """With too many generations at level 0, compact before more is written; an error if that does not help."""
        for _ in range(self.options.stall_retries):
            if self._level0() < self.options.l0_stop:
                return
            self.counters["backpressure"] += 1
            self.compact()
            if self._level0() >= self.options.l0_stop:
                time.sleep(self.options.stall_ms / 1000)
        if self._level0() >= self.options.l0_stop:
            raise OSError("the write stalls: too many generations at level 0")

    def _batch(self, batch: Batch, path: str) -> tuple[int, int]:
        """A batch from the driver, as one file: its rows and deletes."""
        rows = numbered(batch, self.snapshot())
        held = pa.table({f.name: pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(LOG)})
        self.spark.createDataFrame(held, LOG).coalesce(1).write.parquet(f"{self.files.root}/{path}")
        return len(rows), sum(r[2] == DELETE for r in rows)

    def _frame(self, ops: DataFrame, path: str) -> tuple[int, int]:
        """A batch of any size: written once as it is, so that counting and numbering read the same rows; then checked."""
        staged = f"staging/{uuid.uuid4().hex}"
        base = self.snapshot()
        try:
            ops.select("ord", "vtype", "key", "value", "expire_at_ms").write.parquet(f"{self.files.root}/{staged}")
            fixed = self.spark.read.schema(BATCH).parquet(f"{self.files.root}/{staged}")
            sequenced(validate(fixed), base).write.parquet(f"{self.files.root}/{path}")
            found = self.spark.read.schema(LOG).parquet(f"{self.files.root}/{path}").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.when(F.col("vtype") == DELETE, 1)).alias("gone")).first()
            n = fixed.count()
        finally:
            self.files.remove(staged)
        if found["n"] != n or n and (found["first"], found["last"]) != (base + 1, base + n):
            raise RuntimeError(f"{n} operations were given, {found['n']} were written, numbered {found['first']} to {found['last']} after {base}")
        return n, found["gone"]

    def write(self, ops: DataFrame | Batch, stream: tuple[str, int] | None = None) -> int:
        """Append a batch, all or nothing; return the new last sequence number.

        stream: a stream's name and the number of its batch, committed together with the rows.
        """
        with self.turn:
            self._open()
            if isinstance(ops, Batch) and not len(ops):
                return self.snapshot()
            self._backpressure()
            path = f"wal/{uuid.uuid4().hex}"
            try:
                n, gone = self._batch(ops, path) if isinstance(ops, Batch) else self._frame(ops, path)
            except Exception:
                self.files.remove(path)
                raise
            if not n:
                self.files.remove(path)
                return self.snapshot()
            new = {"lastSequence": self.snapshot() + n, "wal": [*self.manifest["wal"], {"path": path, "entries": n}]}
            if stream:
                new["streams"] = self.manifest.get("streams", {}) | {stream[0]: stream[1]}
            self._commit(self.manifest | new, path)
            if isinstance(ops, Batch):
                for _, _, key, _, _ in ops.rows:
                    self.cache.held.pop(key, None)
            else:
                self.cache.held.clear()
            self.counters["writes"] += n
            self.counters["deletes"] += gone
            if sum(g["entries"] for g in self.manifest["wal"]) >= self.options.flush_rows:
                self.flush()
            return self.snapshot()

    def _generation(self, versions: DataFrame, level: int) -> dict | None:
        number = self.manifest["nextFileId"]
        path = f"level={level}/{number}-{uuid.uuid4().hex}"
        key = sort_key(F.col("key"))
        ranged = versions.repartitionByRange(key).sortWithinPartitions(key, F.col("seq").desc()).write
        ranged = ranged.option("parquet.bloom.filter.enabled#key", str(self.options.bloom).lower()).option("parquet.bloom.filter.fpp#key", str(0.6185**self.options.bloom_bits))
        ranged.option("parquet.page.row.count.limit", str(self.options.block_rows)).parquet(f"{self.files.root}/{path}")
        held = self.spark.read.schema(LOG).parquet(f"{self.files.root}/{path}").withColumn("level", F.lit(level)).withColumn("file_id", F.lit(number).cast("long"))
        found = compaction.file_metadata(held).first()
        if found is None:
            self.files.remove(path)
            return None
        return {"path": path} | found.asDict()

    def flush(self) -> None:
        """Unflushed batches become one generation at level 0; then compact if there are enough of those."""
        with self.turn:
            self._open()
            if self.manifest["wal"]:
                made = self._generation(self._read(self.manifest["wal"]), 0)
                self._commit(self.manifest | {"nextFileId": self.manifest["nextFileId"] + 1, "lastFlushedSequence": self.snapshot(), "files": [*self.manifest["files"], *([made] if made else [])], "wal": []}, made and made["path"])
                self.cache.held.clear()
                self.counters["flushes"] += 1
            if self._level0() >= self.options.l0_trigger:
                self.compact()

    def compact(self, purge: bool = True, retain_from_seq: int | None = None) -> None:
        """All flushed generations become at most one at level 1."""
        with self.turn:
            self._open()
            old = self.manifest["files"]
            if not old:
                return
            made = self._generation(compaction.compact(self._read(old), self.clock(), purge, retain_from_seq), 1)
            self._commit(self.manifest | {"nextFileId": self.manifest["nextFileId"] + 1, "files": [made] if made else []}, made and made["path"])
            self.cache.held.clear()
            self.counters["compactions"] += 1
            self.counters["compaction_input"] += sum(g["entries"] for g in old)

    def clean_up(self) -> bool:
        """Compact if that would merge or drop anything: several generations, one at level 0, or an expired version."""
        with self.turn:
            files = self.manifest["files"]
            if len(files) > 1 or self._level0() or (files and compaction.expired_versions(self._read(files), self.clock()).take(1)):
                self.compact()
                return True
            return False

    def start_cleanup(self) -> None:
        """Clean up in the background every cleanup_ms, until close."""
        self._open()
        if self.cleanup:
            return

        def run() -> None:
            while not self.ended.wait(self.options.cleanup_ms / 1000):
                try:
                    self.clean_up()
                except Conflict:
                    log.warning("the cleanup gives way to another writer")
                    return

        self.cleanup = threading.Thread(target=run, name="cleanup", daemon=True)
        self.cleanup.start()

    def close(self) -> None:
        self.ended.set()
        if self.cleanup:
            self.cleanup.join()
            self.cleanup = None
        with self.turn:
            if not self.closed:
                self.flush()
                self.closed = True

    def put(self, key: str, value: bytes) -> int:
        return self.write(Batch().put(key, value))

    def ttl_put(self, key: str, value: bytes, expire_at_ms: int) -> int:
        return self.write(Batch().ttl_put(key, value, expire_at_ms))

    def delete(self, key: str) -> int:
        return self.write(Batch().delete(key))

    def get(self, key: str, snapshot: int | None = None) -> bytes | None:
        """The visible value of a key. Only reads without a snapshot use the cache; expiry is judged at each read."""
        self._open()
        self.counters["reads"] += 1
        began = time.monotonic()
        found, version = self.cache.get(key) if snapshot is None else (False, None)
        if not found:
            rows = reads.get(self.log(), key, 0, snapshot).select("value", "expire_at_ms").collect()  # at most one; nothing is expired at 0
            version = (bytes(rows[0]["value"]), rows[0]["expire_at_ms"]) if rows else None
            if snapshot is None:
                self.cache.put(key, version)
        self._timed("slow_reads", began)
        return version[0] if version and not 0 < version[1] <= self.clock() else None

    def scan(self, start: str, end: str, limit: int | None, snapshot: int | None = None) -> DataFrame:
        """Visible versions of keys in [start, end], in key order: a plan."""
        self._open()
        self.counters["scans"] += 1
        return reads.scan(self.log(), start, end, limit, self.clock(), snapshot).select("key", "value")

    def prefix_scan(self, prefix: str | None, limit: int | None) -> DataFrame:
        self._open()
        self.counters["scans"] += 1
        return reads.prefix_scan(self.log(), prefix, limit, self.clock()).select("key", "value")

    def fetch(self, found: DataFrame) -> list[tuple[str, bytes]]:
        """The rows of a scan with a limit, on the driver; timed."""
        began = time.monotonic()
        rows = [(r["key"], bytes(r["value"])) for r in found.collect()]
        self._timed("slow_scans", began)
        return rows

    def stats(self) -> dict:
        self._open()
        entries = sum(g["entries"] for g in self.manifest["files"] + self.manifest["wal"])
        c, ratio = self.counters, lambda a, b: a / b if b > 0 else 0.0
        return {
            "writes": c["writes"], "reads": c["reads"], "deletes": c["deletes"], "scans": c["scans"], "flushes": c["flushes"], "compactions": c["compactions"],
            "cacheHits": self.cache.hits, "cacheMisses": self.cache.misses, "bloomPositives": 0, "bloomNegatives": 0, "backpressureEvents": c["backpressure"], "slowReads": c["slow_reads"], "slowScans": c["slow_scans"],
            "writeAmplification": ratio(c["writes"] + c["compaction_input"], c["writes"]), "readAmplification": ratio(c["reads"] * max(1, len(self.manifest["files"]) + bool(self.manifest["wal"])), c["reads"]),
            "spaceAmplification": entries / max(1, c["writes"] - c["deletes"]), "cacheHitRate": self.cache.hit_rate(),
            "l0Files": self._level0(), "l1Files": sum(g["level"] == 1 for g in self.manifest["files"]),
        }

    def stats_text(self) -> str:
        return stats.stats_text(self.stats())

    def wal_tail(self, n: int = 20) -> DataFrame:
        self._open()
        return stats.wal_tail(self._read(self.manifest["wal"]), n)

    def inspect(self) -> DataFrame:
        """Each named generation: level, file_id, entries by the manifest and as read, whether it is there."""
        there = {f"{d}/{n}" for d in ("level=0", "level=1") for n in Files(self.spark, f"{self.files.root}/{d}").names()}
        rows = [(g["level"], g["file_id"], g["path"], g["entries"], self._read([g]).count() if g["path"] in there else 0, g["path"] in there, self.options.bloom) for g in self.manifest["files"]]
        return self.spark.createDataFrame(rows, "level int, file_id long, path string, entries long, parsed_entries long, exists boolean, has_bloom boolean").orderBy("level", "file_id")

    def sst_dump(self) -> list[str]:
        files = sorted(self.manifest["files"], key=lambda g: (g["level"], g["file_id"]))
        return [f"fileId={g['file_id']}, level={g['level']}, file={g['path']}, keyRange={g['min_key']}..{g['max_key']}, seqRange={g['min_seq']}..{g['max_seq']}, entries={g['entries']}" for g in files]
