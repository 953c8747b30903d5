"""Counters and amplification of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import safe_divide
from ..schema import DELETE


def amplification(log: DataFrame, physical: DataFrame, compaction_input: int = 0, probes: int = 0, reads: int = 0) -> DataFrame:
    """writes, deletes, and write, read and space amplification, in one pass over each of the two logs."""
    counted = log.agg(F.count("*").alias("writes"), F.count(F.when(F.col("vtype") == DELETE, 1)).alias("deletes"))
    held = physical.agg(F.count("*").alias("entries"))
    long = lambda n: F.lit(n).cast("long")
    return counted.join(F.broadcast(held)).select(  # two rows of one row each
        "writes",
        "deletes",
        safe_divide(F.col("writes") + long(compaction_input), F.col("writes")).alias("write_amplification"),
        safe_divide(long(probes), long(reads)).alias("read_amplification"),
        safe_divide(F.col("entries"), F.greatest(long(1), F.col("writes") - F.col("deletes"))).alias("space_amplification"),
    )


#: The names of the statistics, in their order in the text.
NAMES = ("writes", "reads", "deletes", "scans", "flushes", "compactions", "cacheHits", "cacheMisses", "cacheHitRate", "bloomPositives", "bloomNegatives", "backpressureEvents", "writeAmplification", "readAmplification", "spaceAmplification", "l0Files", "l1Files")


def stats_text(values: dict) -> str:
    """One name=value line each; ratios with four places."""
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(f"{n}={show(values.get(n, 0))}" for n in NAMES) + "\n"


def wal_tail(log: DataFrame, n: int = 20) -> DataFrame:
    """The last n records, in order: a top-k by sequence number."""
    if n <= 0:
        log = log.limit(0)
    kind = F.when(F.col("vtype") == DELETE, "DELETE").otherwise("PUT")
    last = log.orderBy(F.col("seq").desc()).limit(max(n, 0))
    return last.select("seq", kind.alias("type"), "key", F.coalesce(F.octet_length("value"), F.lit(0)).alias("value_size"), "expire_at_ms").orderBy("seq")
