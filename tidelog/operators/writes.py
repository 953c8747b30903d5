"""Writes: batches of operations (ord, op, key, value, expire_at_ms) become rows of the log."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DELETE, NEVER, PUT

#: Rows of one range when a batch is numbered, and the most ranges.
RANGE_ROWS = 250_000
MOST_RANGES = 20_000

BATCH = "ord long, vtype tinyint, key string, value binary, expire_at_ms long"


class Batch:
    """An ordered list of operations."""

    def __init__(self):
        self.rows: list[tuple] = []

    def put(self, key: str, value: bytes | None) -> Batch:
        return self._add(PUT, key, value, NEVER)

    def ttl_put(self, key: str, value: bytes | None, expire_at_ms: int) -> Batch:
        return self._add(PUT, key, value, expire_at_ms)

    def delete(self, key: str) -> Batch:
        return self._add(DELETE, key, None, NEVER)

    def _add(self, vtype, key, value, expire_at_ms) -> Batch:
        self.rows.append((len(self.rows), vtype, key, value, expire_at_ms))
        return self

    def __len__(self) -> int:
        return len(self.rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, BATCH)


def faults(ops: DataFrame) -> DataFrame:
    """Operations that must not be written: a key that is null or empty, a put without a value, an unknown type."""
    bad_key = F.col("key").isNull() | (F.col("key") == "")
    no_value = (F.col("vtype") == PUT) & F.col("value").isNull()
    unknown = F.col("vtype").isNull() | ~F.col("vtype").isin(PUT, DELETE)
    why = F.when(bad_key, "key must not be empty").when(no_value, "value must not be null").when(unknown, "unknown type")
    return ops.withColumn("fault", why).where("fault is not null")


def validate(ops: DataFrame) -> DataFrame:
    """The operations, if all are sound; else ValueError and nothing is written."""
    bad = faults(ops).orderBy("ord").limit(1).collect()
    if bad:
        raise ValueError(f"operation {bad[0]['ord']}: {bad[0]['fault']}")
    return ops


def numbered(batch: Batch, base: int) -> list[tuple]:
    """The log rows of a sound batch that is on the driver, with seq base + 1, ...; else ValueError."""
    for ord_, vtype, key, value, _ in batch.rows:
        why = "key must not be empty" if not key else "value must not be null" if vtype == PUT and value is None else None
        if why:
            raise ValueError(f"operation {ord_}: {why}")
    return [(key, base + 1 + k, vtype, value if vtype == PUT else None, at) for k, (_, vtype, key, value, at) in enumerate(batch.rows)]


def sequenced(ops: DataFrame, base: int) -> DataFrame:
    """The operations as log rows with seq base + 1, base + 2, ... in order of ord; equal ords go by the other columns.

    A row's range of ord follows from its value alone, and its number from its place in the range, so the numbers
    do not depend on how a plan is cut into tasks. Only the ranges' sizes are gathered, so a batch may be of any
    size. The input must hold the same rows each time it is read.
    """
    n = ops.count()
    placed = ops.withColumn("_part", F.lit(0.0))
    if n > RANGE_ROWS:
        place = F.coalesce(F.col("ord").cast("double"), F.lit(float("-inf")))
        parts = min(MOST_RANGES, -(-n // RANGE_ROWS))
        marks = ops.agg(F.percentile_approx(place, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10 * parts)).first()[0]
        splits = [float("-inf"), *sorted({m for m in marks if m > float("-inf")}), float("inf")]
        placed = Bucketizer(splits=splits, inputCol="_place", outputCol="_part").transform(ops.withColumn("_place", place)).drop("_place")
    starts, at = [], base
    for row in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row a range
        starts.append((row["_part"], at))
        at += row["n"]
    offsets = ops.sparkSession.createDataFrame(starts, "_part double, _base long")
    order = Window.partitionBy("_part").orderBy("ord", "key", "vtype", "value", "expire_at_ms")
    out = placed.withColumn("_at", F.row_number().over(order)).join(F.broadcast(offsets), "_part")
    return out.select("key", (F.col("_base") + F.col("_at")).alias("seq"), F.col("vtype").cast("tinyint").alias("vtype"), F.when(F.col("vtype") == PUT, F.col("value")).alias("value"), F.col("expire_at_ms"))
