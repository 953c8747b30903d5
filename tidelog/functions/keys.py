"""Key order is that of UTF-16 code units; Spark's own is that of UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_key(key: Column) -> Column:
    return F.encode(key, "UTF-16BE")


def _plain(bound: str) -> bool:
    """Against such a bound both orders agree, so the comparison can be pushed down to the scan."""
    return all(c < "\ud800" for c in bound)


def between(key: Column, start: str, end: str) -> Column:
    """start <= key <= end, both ends included."""
    low = key >= start if _plain(start) else sort_key(key) >= sort_key(F.lit(start))
    high = key <= end if _plain(end) else sort_key(key) <= sort_key(F.lit(end))
    return low & high


def with_prefix(key: Column, prefix: str | None) -> Column:
    return key.startswith(prefix or "")
