"""A stream of operations appended to a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import VersionStore


def ingest(ops: DataFrame, store: VersionStore, checkpoint: str, **trigger) -> DataStreamWriter:
    """Write a stream (ord, vtype, key, value, expire_at_ms) to the store. ord orders operations within a micro-batch.

    A batch's number is committed in one manifest with its rows, so a batch that failed is written when it is replayed, and
    one that was written is not written again.
    """

    def write(batch: DataFrame, number: int) -> None:
        if store.manifest.get("streams", {}).get(checkpoint, -1) < number:
            store.write(batch, (checkpoint, number))

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
