"""Merging logs: one version a key, with or without what a reader would not see."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reads import expired, latest, live

STYLES = ("leveled", "size-tiered")


def parse_style(text: str | None) -> str:
    """Both styles merge alike; the name is kept for configurations."""
    name = (text or "").strip().lower().replace("_", "-") or "leveled"
    name = "size-tiered" if name == "size-tired" else name
    if name not in STYLES:
        raise ValueError(f"unknown compaction style: {text}")
    return name


def compact(log: DataFrame, now_ms: int, purge: bool = True, retain_from_seq: int | None = None) -> DataFrame:
    """The newest version of each key; purge drops deletes and expired ones.

    With retain_from_seq, all versions from there on and the newest before stay, so that snapshots from there
    on still read the same.
    """
    if retain_from_seq is None:
        newest = latest(log)
        return newest.where(live(now_ms)) if purge else newest
    old = latest(log.where(F.col("seq") < retain_from_seq))
    return log.where(F.col("seq") >= retain_from_seq).unionByName(old.where(live(now_ms)) if purge else old)


def replay(wal: DataFrame, last_flushed: int) -> DataFrame:
    return wal.where(F.col("seq") > last_flushed)


def replay_summary(wal: DataFrame, last_flushed: int) -> DataFrame:
    """Records applied and the greatest sequence number (at least the flushed one)."""
    return replay(wal, last_flushed).agg(F.count("*").alias("applied"), F.greatest(F.coalesce(F.max("seq"), F.lit(0).cast("long")), F.lit(last_flushed).cast("long")).alias("max_seq"))


def file_metadata(log: DataFrame) -> DataFrame:
    """level, file_id, bounds of keys and sequence numbers, entries, of a log with those two columns."""
    from ..functions.keys import sort_key

    return log.groupBy("level", "file_id").agg(
        F.min_by("key", sort_key(F.col("key"))).alias("min_key"),
        F.max_by("key", sort_key(F.col("key"))).alias("max_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.count("*").alias("entries"),
    )


def sst_dump(log: DataFrame) -> DataFrame:
    """A line per file, by level and file."""
    line = F.format_string("fileId=%d, level=%d, file=sst-%d-L%d.sst, bloom=sst-%d-L%d.sst.bf, keyRange=%s..%s, seqRange=%d..%d, entries=%d", "file_id", "level", "file_id", "level", "file_id", "level", "min_key", "max_key", "min_seq", "max_seq", "entries")
    return file_metadata(log).select("level", "file_id", line.alias("line")).orderBy("level", "file_id")


def expired_versions(log: DataFrame, now_ms: int) -> DataFrame:
    return log.where(expired(now_ms))


def manifest_json(next_file_id: int, last_flushed: int, files: list[dict]) -> str:
    return json.dumps({"nextFileId": next_file_id, "lastFlushedSequence": last_flushed, "files": files}, indent=2)
