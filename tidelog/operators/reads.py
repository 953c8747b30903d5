"""Reads: the latest visible version of keys, points, ranges, prefixes and key lists.

Versions after the snapshot go before the choice of the newest one; deletes and expiry are judged on the newest
one only, so a deleted or expired version hides older ones. Bounds include both ends; expiry includes its moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import kind, text
from ..functions.keys import between, sort_key, with_prefix
from ..schema import DELETE, PUT

WRONG_TYPE = "WRONGTYPE Operation against a key holding the wrong kind of value"
KEYS_LIMIT = 1000


def expired(now_ms: int | Column, at: Column | None = None) -> Column:
    at = F.col("expire_at_ms") if at is None else at
    return (at > 0) & (at <= now_ms)


def live(now_ms: int) -> Column:
    return (F.col("vtype") == PUT) & ~expired(now_ms)


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest version of each key, deletes included.

    A window limited to its first row: Spark keeps one row a key and task before the shuffle, so a hot key
    never travels whole. A filter on key passes below the window to the scan.
    """
    seen = log if snapshot is None else log.where(F.col("seq") <= snapshot)
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc(), F.col("vtype"))
    return seen.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def latest_visible(log: DataFrame, now_ms: int, snapshot: int | None = None) -> DataFrame:
    return latest(log, snapshot).where(live(now_ms))


def get(log: DataFrame, key: str, now_ms: int, snapshot: int | None = None) -> DataFrame:
    """The visible version of one key, or no row: a top-1, without a shuffle of the log."""
    seen = log.where(F.col("key") == key)
    seen = seen if snapshot is None else seen.where(F.col("seq") <= snapshot)
    return seen.orderBy(F.col("seq").desc(), "vtype").limit(1).where(live(now_ms))


def get_as_of(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """Each request (key, snapshot) with the value it sees, or null. Requests and versions are merged in one sort by key."""
    points = requests.select("key", F.col("snapshot").alias("seq"), F.lit(None).cast("tinyint").alias("vtype"), F.lit(None).cast("binary").alias("value"), F.lit(-1).cast("long").alias("expire_at_ms"), F.lit(True).alias("asks"))
    wanted = requests.select("key").distinct()
    both = log.join(wanted, "key", "left_semi").select("key", "seq", "vtype", "value", "expire_at_ms", F.lit(False).alias("asks")).unionByName(points)
    so_far = Window.partitionBy("key").orderBy("seq", "asks", F.col("vtype").desc()).rowsBetween(Window.unboundedPreceding, 0)
    version = F.when(~F.col("asks"), F.struct("seq", "vtype", "value", "expire_at_ms"))
    seen = both.withColumn("v", F.last(version, ignorenulls=True).over(so_far)).where("asks")
    ok = (F.col("v.vtype") == PUT) & ~expired(now_ms, F.col("v.expire_at_ms"))
    return seen.select("key", F.col("seq").alias("snapshot"), F.when(ok, F.col("v.seq")).alias("seq"), F.when(ok, F.col("v.value")).alias("value"))


def _in_order(found: DataFrame, limit: int | None) -> DataFrame:
    """By key: a top-k with a limit, ranges sorted in parallel without one."""
    ordered = found.orderBy(sort_key(F.col("key")))
    return ordered if limit is None else ordered.limit(max(0, limit))


def scan(log: DataFrame, start: str, end: str, limit: int | None, now_ms: int, snapshot: int | None = None) -> DataFrame:
    """Visible versions of keys in [start, end], in key order, at most limit."""
    return _in_order(latest_visible(log.where(between(F.col("key"), start, end)), now_ms, snapshot), limit)


def prefix_scan(log: DataFrame, prefix: str | None, limit: int | None, now_ms: int, snapshot: int | None = None) -> DataFrame:
    return _in_order(latest_visible(log.where(with_prefix(F.col("key"), prefix)), now_ms, snapshot), limit)


def keys(log: DataFrame, pattern: str, now_ms: int, limit: int = KEYS_LIMIT) -> DataFrame:
    """Keys for *, a prefix with * behind it, or one exact key; there are no other patterns."""
    if pattern.endswith("*"):
        return prefix_scan(log, pattern[:-1], limit, now_ms).select("key")
    return get(log, pattern, now_ms).select("key")


def _wanted(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """The visible versions of requested keys; only their versions pass the scan's side of the semi-join."""
    return latest_visible(log.join(requests.select("key").distinct(), "key", "left_semi"), now_ms)


def mget(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """Each request (ord, key) with its text, (nil), or an error for a structured value; repeats are answered each."""
    held = _wanted(log, requests, now_ms).select("key", "value")
    answer = F.when(F.col("value").isNull(), "(nil)").when(kind(F.col("value")) != "string", f"(error) {WRONG_TYPE}").otherwise(text(F.col("value")))
    return requests.join(held, "key", "left").select("ord", "key", answer.alias("value"))


def exists_count(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """How many requests (key) are present; repeats count each."""
    return requests.join(_wanted(log, requests, now_ms).select("key"), "key").agg(F.count("*").alias("n"))


def delete_present(log: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """The keys to write deletes for: requested and present, once each."""
    return _wanted(log, requests, now_ms).select("key")


def hidden(log: DataFrame, now_ms: int) -> DataFrame:
    """Keys whose newest version hides an older put: key, by (delete or expiry)."""
    newest = latest(log).where(~live(now_ms)).select("key", F.when(F.col("vtype") == DELETE, "delete").otherwise("expiry").alias("by"))
    return newest.join(log.where(F.col("vtype") == PUT).select("key", F.col("seq").alias("older")), "key", "left").groupBy("key", "by").agg(F.count("older").alias("puts"))
