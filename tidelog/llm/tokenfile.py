"""Token ids in files: static range asymmetric numeral system (rANS) over independent interleaved blocks.

One frequency table, over all ids of all documents, is shared by every file. A file holds the ids of consecutive
documents in blocks of up to BLOCK ids; each block has LANES interleaved coder states, so it decodes alone and
many blocks decode at once. The footer holds a checkpoint per block (first id, byte place, words, crc32 of the
ids) and the documents' ids and lengths.

    file   = magic, blocks, footer, footer length (8 bytes), crc32 of the footer (4 bytes), magic
    block  = LANES states of 8 bytes, then 4-byte words in the decoder's order
    footer = counts (scale, table crc32, blocks, documents, ids), checkpoints, doc nulls, doc ids, doc lengths

Rules for odd input: null text is an empty one (the document is the end id alone); a very long text is encoded
whole, in one task's memory, and makes a longer file; a null doc_id sorts first; repeated doc_ids go by text; an
empty table gives no files and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, input_columns, materialize, register, scratch, spread, write_file
from .tokens import encoded, tokenizer

MAGIC = b"TIDErANS"
LANES = 32
BLOCK = 1 << 16
#: Ids of one file (a longer document makes a longer file) and of one read task.
FILE_IDS = 4 << 20
READ_IDS = 1 << 20
#: Counts that travel in one row.
COUNTS = 1 << 13
#: Blocks that are coded side by side.
TOGETHER = 32
LOW = 1 << 31
CHECKPOINT = np.dtype([("first", "<u8"), ("place", "<u8"), ("n", "<u4"), ("words", "<u4"), ("crc", "<u4")])


class Table(NamedTuple):
    """freq sums to 1 << scale; every id that occurs has at least 1."""

    scale: int
    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def build_table(freq: np.ndarray) -> Table:
    freq = np.asarray(freq, np.uint64)
    scale = int(freq.sum()).bit_length() - 1
    start = np.cumsum(freq) - freq
    return Table(scale, freq, start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)))


def quantize(counts: np.ndarray) -> np.ndarray:
    """Counts to frequencies that sum to a power of two, at least 1 where the count is not 0."""
    counts = np.asarray(counts, np.float64)
    used = np.flatnonzero(counts)
    if not len(used):
        counts, used = np.ones(len(counts) or 1), np.arange(len(counts) or 1)
    scale = max(16, int(len(used)).bit_length() + 3)
    freq = np.zeros(len(counts), np.int64)
    share = counts[used] / counts[used].sum() * ((1 << scale) - len(used))
    freq[used] = 1 + np.floor(share).astype(np.int64)
    left = (1 << scale) - int(freq.sum())
    order = used[np.argsort(-(share - np.floor(share)), kind="stable")]
    freq[order[:left]] += 1
    return freq


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of equal length, one a row of ids."""
    blocks, n = ids.shape
    steps = -(-n // LANES)
    padded = np.full((blocks, steps * LANES), ids[0, 0], np.uint32)
    padded[:, :n] = ids
    padded = padded.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.empty((blocks, steps, LANES), "<u4")
    put = np.empty((blocks, steps, LANES), bool)
    shift, room = np.uint64(table.scale), np.uint64(31 + 32 - table.scale)
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[padded[:, t]], table.start[padded[:, t]]
        words[:, t] = state & np.uint64(0xFFFFFFFF)
        full = put[:, t] = state >= f << room
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << shift) + (state - q * f) + c
    return [state[b].astype("<u8").tobytes() + words[b][put[b]].tobytes() for b in range(blocks)]


def decode_blocks(blocks: list[bytes], n: int, table: Table) -> np.ndarray:
    """Ids of blocks of equal length n, one a row."""
    steps, head = -(-n // LANES), 8 * LANES
    state = np.stack([np.frombuffer(b, "<u8", LANES) for b in blocks]).astype(np.uint64)
    words = np.frombuffer(b"".join(b[head:] for b in blocks) + bytes(4 * LANES), "<u4").astype(np.uint64)
    at = np.cumsum([0] + [(len(b) - head) // 4 for b in blocks])[:-1][:, None]
    out = np.empty((len(blocks), steps, LANES), np.uint32)
    shift, mask = np.uint64(table.scale), np.uint64((1 << table.scale) - 1)
    for t in range(steps):
        slot = state & mask
        s = out[:, t] = table.symbol[slot]
        state = table.freq[s] * (state >> shift) + slot - table.start[s]
        need = state < np.uint64(LOW)
        place = at + np.cumsum(need, axis=1) - need
        state = np.where(need, state << np.uint64(32) | words[np.minimum(place, len(words) - 1)], state)
        at = at + need.sum(axis=1, keepdims=True)
    return out.reshape(len(blocks), steps * LANES)[:, :n]


def file_bytes(ids: np.ndarray, doc_ids: list, lengths: list[int], table: Table):
    """A file's chunks of bytes, in order."""
    yield MAGIC
    n, place, made = len(ids), len(MAGIC), []
    full = n // BLOCK
    jobs = [(a, min(full, a + TOGETHER), BLOCK) for a in range(0, full, TOGETHER)]
    jobs += [(full, full + 1, n - full * BLOCK)] if n % BLOCK else []
    for a, b, size in jobs:
        rows = ids[a * BLOCK : a * BLOCK + (b - a) * size].reshape(b - a, size)
        for k, block in enumerate(encode_blocks(rows, table)):
            made.append((a * BLOCK + k * size, place, size, (len(block) - 8 * LANES) // 4, zlib.crc32(rows[k].astype("<u4").tobytes())))
            place += len(block)
            yield block
    nulls = np.array([i is None for i in doc_ids], "u1")
    footer = b"".join([
        np.array([table.scale, table.crc, len(made), len(doc_ids), n], "<u8").tobytes(),
        np.array(made, CHECKPOINT).tobytes(),
        nulls.tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
    ])
    yield footer + len(footer).to_bytes(8, "little") + zlib.crc32(footer).to_bytes(4, "little") + MAGIC


class TokenFile:
    """Random access to one file: the footer, then any span of ids by its checkpoints."""

    def __init__(self, uri: str, table: Table):
        fs, path = filesystem(uri)
        self.table, self.file = table, fs.open_input_file(path)
        size, tail = self.file.size(), 12 + len(MAGIC)
        if size < tail + len(MAGIC):
            raise ValueError(f"{uri} is too short")
        end = self.file.read_at(tail, size - tail)
        n = int.from_bytes(end[:8], "little")
        if end[12:] != MAGIC or n > size - tail:
            raise ValueError(f"{uri} is no token file")
        footer = self.file.read_at(n, size - tail - n)
        if zlib.crc32(footer) != int.from_bytes(end[8:12], "little"):
            raise ValueError(f"{uri}: the footer's checksum is wrong")
        scale, crc, blocks, docs, self.n = np.frombuffer(footer, "<u8", 5).tolist()
        if (scale, crc) != (table.scale, table.crc):
            raise ValueError(f"{uri} was written with another frequency table")
        self.points = np.frombuffer(footer, CHECKPOINT, blocks, 40)
        at = 40 + CHECKPOINT.itemsize * blocks
        nulls = np.frombuffer(footer, "u1", docs, at)
        ids = np.frombuffer(footer, "<i8", docs, at + docs)
        self.doc_ids = [None if gone else i for gone, i in zip(nulls.tolist(), ids.tolist(), strict=True)]
        self.lengths = np.frombuffer(footer, "<u8", docs, at + 9 * docs).astype(np.int64)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def spans(self, first: int, last: int):
        """The ids from first up to last, in pieces of at most TOGETHER blocks; checksums are verified."""
        starts = self.points["first"].astype(np.int64)
        lo, hi = int(np.searchsorted(starts, first, "right")) - 1, int(np.searchsorted(starts, last, "left"))
        while lo < hi:
            up = min(hi, lo + TOGETHER)
            n = int(self.points["n"][lo])
            while self.points["n"][up - 1] != n:
                up -= 1
            points = self.points[lo:up]
            a = int(points["place"][0])
            sizes = 8 * LANES + 4 * points["words"].astype(np.int64)
            raw = self.file.read_at(int(sizes.sum()), a)
            cuts = np.cumsum([0, *sizes.tolist()]).tolist()
            rows = decode_blocks([raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], n, self.table)
            for k, crc in enumerate(points["crc"].tolist()):
                if zlib.crc32(rows[k].astype("<u4").tobytes()) != crc:
                    raise ValueError(f"block {lo + k}: the ids' checksum is wrong")
            base = int(starts[lo])
            yield rows.reshape(-1)[max(0, first - base) : max(0, last - base)]
            lo = up


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> tuple[DataFrame, np.ndarray]:
    """Encode whole texts and write their ids in ascending doc_id order. Return the files' manifest and the shared frequencies.

    Documents are dealt by ranges of doc_id once, as texts; their ids are kept (2 or 4 bytes each) until all
    are counted, then coded. A file counts only if the manifest names it, so a lost or repeated task does no harm.
    Manifest: path, n_docs, n_tokens, start (ids in all files before it, by a prefix sum over the tasks and one in each).
    """
    with scratch(docs.sparkSession):
        return _write(docs, tokenizer_path, end_id, doc_id, text, file_ids)


def _write(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str, text: str, file_ids: int) -> tuple[DataFrame, np.ndarray]:
    spark = docs.sparkSession
    named = input_columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def tokenise(batches):
        part_no, pos, counts = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for part, ids, bounds in encoded(batch, tokenizer_path, end_id):
                tok, rows = tokenizer(tokenizer_path), part.num_rows
                counts = np.zeros(tok.size, np.int64) if counts is None else counts
                counts += np.bincount(ids, minlength=tok.size)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer((bounds * tok.dtype.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part_no] * rows, pa.int32()), pa.array(np.arange(pos, pos + rows)), part.column("doc_id"), raw, pa.nulls(rows, pa.binary())], names=["part", "pos", "doc_id", "ids", "counts"])
                pos += rows
        if counts is not None:
            raw = counts.astype("<i8").tobytes()
            pieces = [raw[k : k + 8 * COUNTS] for k in range(0, len(raw), 8 * COUNTS)]
            n = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array([part_no] * n, pa.int32()), pa.array([-1 - k for k in range(n)], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(pieces, pa.binary())], names=["part", "pos", "doc_id", "ids", "counts"])

    path = register(fresh_path(spark, "ids"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tokenise, "part int, pos long, doc_id long, ids binary, counts binary").write.option("compression", "zstd").parquet(path)
    held = spark.read.parquet(path)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for pos, raw in zip(batch.column("pos").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[pos] = sums.get(pos, 0) + np.frombuffer(raw, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["pos", "counts"])

    size = tokenizer(tokenizer_path).size
    counts = np.zeros(size, np.int64)
    for row in held.where("pos < 0").select("pos", "counts").repartition("pos").mapInArrow(total, "pos long, counts binary").collect():  # the vocabulary's size
        at = (-1 - row["pos"]) * COUNTS
        counts[at : at + COUNTS] = np.frombuffer(row["counts"], "<i8")
    freq, folder, dtype = quantize(counts), fresh_path(spark, "token-files"), tokenizer(tokenizer_path).dtype

    def write(batches):
        table, held_ids, held_docs, lengths, key, n = build_table(freq), [], [], [], None, 0

        def flush():
            uri = f"{folder}/{key[0]:06d}-{key[1]:012d}-{uuid.uuid4().hex}.rans"
            write_file(uri, file_bytes(np.concatenate(held_ids), held_docs, lengths, table))
            row = {"part": [key[0]], "pos": [key[1]], "path": [uri], "n_docs": [len(held_docs)], "n_tokens": [n]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for part, pos, i, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "pos", "doc_id", "ids")), strict=True):
                if key and (n >= file_ids or (part, pos) != (key[0], key[1] + len(held_docs))):
                    yield flush()
                    held_ids, held_docs, lengths, key, n = [], [], [], None, 0
                key = key or (part, pos)
                ids = np.frombuffer(raw, dtype)
                held_ids.append(ids)
                held_docs.append(i)
                lengths.append(len(ids))
                n += len(ids)
        if key:
            yield flush()

    files = register(fresh_path(spark, "token-parts"))
    held.where("pos >= 0").select("part", "pos", "doc_id", "ids").mapInArrow(write, "part int, pos long, path string, n_docs long, n_tokens long").write.parquet(files)
    made = spark.read.parquet(files)
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a task that wrote
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    manifest = made.join(F.broadcast(before), "part").select("path", "n_docs", "n_tokens", (F.col("base") + inside).alias("start"))
    return materialize(manifest, "token-manifest", keep=True), freq


def read_token_files(manifest: DataFrame, freq: np.ndarray, read_ids: int = READ_IDS) -> DataFrame:
    """Documents of the files, decoded in parallel from the checkpoints: doc_id, start, n_tokens, ids_crc32."""
    units = manifest.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {read_ids}"))))

    def run(batches):
        table = build_table(freq)
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with TokenFile(row["path"], table) as file:
                    ends = np.cumsum(file.lengths)
                    starts = ends - file.lengths
                    lo, hi = np.searchsorted(starts, [row["unit"] * read_ids, (row["unit"] + 1) * read_ids]).tolist()
                    if lo < hi:
                        k, crc, at = lo, 0, int(starts[lo])
                        for ids in file.spans(at, int(ends[hi - 1])):
                            raw, used = memoryview(ids.astype("<u4").view("u1")), 0
                            while k < hi and (take := min(int(ends[k]) - at, len(ids) - used)) >= 0:
                                crc = zlib.crc32(raw[4 * used : 4 * (used + take)], crc)
                                used, at = used + take, at + take
                                if at < ends[k]:
                                    break
                                out.append((file.doc_ids[k], row["start"] + int(starts[k]), int(file.lengths[k]), crc))
                                k, crc = k + 1, 0
                        if k != hi:
                            raise ValueError(f"{row['path']}: documents end early")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread(units, "path", "unit").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    manifest, freq = write_token_files(docs, tokenizer_path, end_id)
    return read_token_files(manifest, freq)
