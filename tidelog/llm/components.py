"""Connected components of a graph, by local contraction and alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

ROUNDS = 60
#: Edges up to which one task finishes the work (about 100 MB); beyond, the rounds of stars do.
LOCAL_EDGES = 500_000


def _contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars: (a, b) with b the least of a's component within the partition."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step; edges point from the greater to the less."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    large = materialize(large, "stars")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """set_id, root of every end of an edge (a, b): root is the least id that it is connected with."""
    with scratch(edges.sparkSession):
        now = materialize(_contract(edges.select("a", "b")), "edges")
        for _ in range(ROUNDS):
            if now.count() <= LOCAL_EDGES:
                now = materialize(_contract(now.coalesce(1)), "edges")
                break
            # Done when every greater end has one edge and no lesser end is a greater one: all are stars.
            ends = now.groupBy("a").agg(F.count_distinct("b").alias("n"))
            if not ends.where("n > 1").take(1) and not now.select(F.col("b").alias("a")).join(ends, "a", "left_semi").take(1):
                break
            now = materialize(_contract(materialize(_stars(now), "stars")), "edges")
        else:
            raise ValueError(f"components did not settle in {ROUNDS} rounds")
        now = now.distinct()
        roots = now.select(F.col("b").alias("set_id"), F.col("b").alias("root")).distinct()
        return materialize(now.select(F.col("a").alias("set_id"), F.col("b").alias("root")).unionByName(roots), "components", keep=True)
