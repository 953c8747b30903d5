"""Packing of token sequences by best-fit decreasing.

Rules for odd input: a null text is an empty one (its document is the end id alone); a very long text is encoded
whole, in one task's memory, and cut into as many windows as it needs; a null doc_id stays null; repeated rows are
packed once each and dealt over all shards; ties in length go by doc_id, start and crc; an empty table gives no
rows; columns other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_columns, materialize
from .tokens import encoded

WINDOW = 4096
#: Pieces that one task packs together; more shards, never larger ones, for more input.
SHARD_PIECES = 50_000

#: Text that is encoded at once (a task's arrays take about ten times as much).
CUT_BYTES = 3 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over 0..window counts them, and finds the tightest fit."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, remaining: int, which: int) -> None:
        self.held[remaining].append(which)
        node = self.leaves + remaining
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window with the least remaining capacity of at least length, removed; None if none has it."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return remaining, self.held[remaining].pop()


def best_fit_decreasing(lengths, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For lengths in descending order, each at most window: its window's number and its offset there."""
    tree, which, offsets, made = OpenWindows(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found, made = (window, made), made + 1
        remaining, at = found
        which.append(at)
        offsets.append(window - remaining)
        if remaining > length:
            tree.add(remaining - length, at)
    return which, offsets


def cut(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids, cut into full windows and one shorter rest: one row a piece, without the ids."""

    def run(batches):
        for batch in batches:
            for part, ids, bounds in encoded(batch, tokenizer_path, end_id, CUT_BYTES):
                wide = memoryview(ids.astype("<u4").view(np.uint8))
                rows = [
                    (i, at, min(window, n - at), zlib.crc32(wide[4 * (a + at) : 4 * (a + min(at + window, n))]), n)
                    for i, a, n in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True)
                    for at in range(0, n, window)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    named = input_columns(docs, doc_id=doc_id, text=text)
    return named.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Sequence and offset of every piece. Pieces are dealt by hash into shards of about shard_pieces, each packed alone.

    A sequence's id is its shard's number times 2^32 plus its number there.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))

    def run(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        which, offsets = best_fit_decreasing(rows["length"].to_pylist(), window)
        sequence = (rows["shard"][0].as_py() << 32) + np.array(which, np.int64)
        return rows.drop_columns("shard").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    # The row's place keeps repeated rows apart, which would else meet in one shard.
    place = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    return pieces.withColumn("shard", F.pmod(place, F.lit(shards))).groupBy("shard").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise whole texts, cut, and pack: one row a piece, with its sequence and offset."""
    return pack(materialize(cut(docs, tokenizer_path, end_id, window, doc_id, text), "pieces"), window)
