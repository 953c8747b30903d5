"""Readers and writers of raw store files: the write-ahead log, sorted tables and their Bloom filters.

All numbers are big-endian; texts are UTF-8; a length of -1 is a null and reads as empty.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.bloom import MAX_LONG, PRIME, SEED_1, SEED_2, sizes
from ..schema import COLUMNS

#: Largest frame, magic numbers and version of the formats.
MAX_FRAME = 32 << 20
TABLE_HEAD, TABLE_FOOT, BLOOM_HEAD, VERSION = 0x534B5654, 0x534B5646, 0x534B5642, 1
FOOT = struct.Struct(">qiiqi")

LOG_DDL = "key string, seq long, vtype tinyint, value binary, expire_at_ms long"


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str):
        out = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return out if len(out) > 1 else out[0]

    def bytes(self) -> bytes:
        n = max(0, self.take("i"))
        if self.at + n > len(self.data):
            raise ValueError("a value runs over the end")
        self.at += n
        return self.data[self.at - n : self.at]


def wal_rows(data: bytes) -> list[tuple]:
    """Records in order, up to the first frame that is short, too large or has a wrong checksum."""
    rows, at = [], 0
    while at + 8 <= len(data):
        size, crc = struct.unpack_from(">iI", data, at)
        payload = data[at + 8 : at + 8 + max(size, 0)]
        if size <= 0 or size > MAX_FRAME or len(payload) < size or zlib.crc32(payload) != crc:
            break
        c = Cursor(payload)
        for _ in range(max(0, c.take("i"))):
            seq, vtype, expire = c.take("qbq")
            key = c.bytes().decode("utf-8", "replace")
            rows.append((key, seq, vtype, c.bytes() if vtype == 1 else (c.bytes(), None)[1], expire))
        at += 8 + size
    return rows


def wal_bytes(frames: list[list[tuple]]) -> bytes:
    """Frames of records (key, seq, vtype, value, expire_at_ms)."""
    out = b""
    for rows in frames:
        payload = struct.pack(">i", len(rows))
        for key, seq, vtype, value, expire in rows:
            raw = key.encode()
            payload += struct.pack(">qbq", seq, vtype, expire) + struct.pack(">i", len(raw)) + raw
            payload += struct.pack(">i", -1) if value is None else struct.pack(">i", len(value)) + value
        out += struct.pack(">iI", len(payload), zlib.crc32(payload)) + payload
    return out


def entry_order(row: tuple) -> tuple:
    """By key in UTF-16 code units, the newest version first."""
    return row[0].encode("utf-16-be", "surrogatepass"), -row[1]


def _bytes(value: bytes | None) -> bytes:
    return struct.pack(">i", -1) if value is None else struct.pack(">i", len(value)) + value


def table_bytes(rows: list[tuple], block_rows: int = 128) -> bytes:
    """A sorted table of records (key, seq, vtype, value, expire_at_ms): blocks, an index of their first entries, a footer."""
    if not rows:
        raise ValueError("a table needs an entry")
    rows = sorted(rows, key=entry_order)
    body, index = struct.pack(">ii", TABLE_HEAD, VERSION), []
    blocks = [rows[k : k + block_rows] for k in range(0, len(rows), block_rows)]
    for block in blocks:
        index.append((block[0][0], block[0][1], len(body)))
        body += struct.pack(">i", len(block)) + b"".join(_bytes(k.encode()) + struct.pack(">qbq", seq, vtype, expire) + _bytes(value) for k, seq, vtype, value, expire in block)
    at = struct.pack(">i", len(index)) + b"".join(_bytes(k.encode()) + struct.pack(">qq", seq, place) for k, seq, place in index)
    return body + at + FOOT.pack(len(body), len(at), len(blocks), len(rows), TABLE_FOOT)


def _fnv(data: bytes, h: int) -> int:
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFF
    return h


def key_bits(key: str, bits: int, k: int) -> list[int]:
    """The bits of a key in a filter, as in functions.bloom."""
    raw = key.encode()
    a, b = _fnv(raw, SEED_1), _fnv(raw, SEED_2)
    return [(a + i * b & MAX_LONG) % bits for i in range(k)]


def bloom_bytes(keys, bits_per_key: int = 10) -> bytes:
    """A filter file over the distinct keys."""
    keys = set(keys)
    bits, k = sizes(len(keys), bits_per_key)
    held = 0
    for key in keys:
        for bit in key_bits(key, bits, k):
            held |= 1 << bit
    raw = held.to_bytes((held.bit_length() + 7) // 8, "little")
    return struct.pack(">iiiii", BLOOM_HEAD, VERSION, bits, k, len(raw)) + raw


def might_contain(data: bytes | None, key: str) -> bool:
    """Whether a table may hold a key by its filter file; a missing or damaged filter excludes nothing."""
    try:
        bits, k, held = bloom_bits(data or b"")
    except (ValueError, struct.error):
        return True
    return all(held >> bit & 1 for bit in key_bits(key, bits, k))


def table_rows(data: bytes) -> list[tuple]:
    """Entries of a sorted table file; ValueError if it is damaged."""
    if len(data) < 8 + FOOT.size or struct.unpack_from(">ii", data) != (TABLE_HEAD, VERSION):
        raise ValueError("no sorted table")
    index, index_size, blocks, entries, magic = FOOT.unpack_from(data, len(data) - FOOT.size)
    if magic != TABLE_FOOT or entries < 1 or not 8 <= index <= index + index_size <= len(data) - FOOT.size:
        raise ValueError("the table's footer is wrong")
    c, rows = Cursor(data, 8), []
    for _ in range(blocks):
        for _ in range(c.take("i")):
            key = c.bytes().decode("utf-8", "replace")
            seq, vtype, expire = c.take("qbq")
            value = c.bytes()
            rows.append((key, seq, vtype, value if vtype == 1 else None, expire))
    if len(rows) != entries or c.at != index:
        raise ValueError("the table's entries are not as many as it says")
    return sorted(rows, key=entry_order)


def bloom_bits(data: bytes) -> tuple[int, int, int]:
    """Size in bits, number of hash functions, and the bits as one number (bit 0 lowest)."""
    magic, version, bits, k, n = struct.unpack_from(">iiiii", data)
    if (magic, version) != (BLOOM_HEAD, VERSION) or len(data) < 20 + n:
        raise ValueError("no Bloom filter")
    return bits, k, int.from_bytes(data[20 : 20 + n], "little")


def _read(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(parse(bytes(content)), columns=COLUMNS)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, LOG_DDL)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Rows of write-ahead logs; files are decoded in parallel, each whole."""
    return _read(spark, path, wal_rows)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of sorted table files; files are decoded in parallel, each whole."""
    return _read(spark, path, table_rows)


def _plain(rows: pd.DataFrame) -> list[tuple]:
    return [(k, int(s), int(t), None if v is None else bytes(v), int(e)) for k, s, t, v, e in rows[COLUMNS].itertuples(index=False)]


def encode_wal(log: DataFrame, frame: str) -> DataFrame:
    """frame, content: one log frame for each value of a column, its records in order of seq. A frame must fit a task, and MAX_FRAME to be read again."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"frame": [int(rows[frame].iloc[0])], "content": [wal_bytes([_plain(rows.sort_values("seq"))])]})

    return log.groupBy(frame).applyInPandas(run, "frame long, content binary")


def encode_tables(log: DataFrame, block_rows: int = 128, bits_per_key: int = 10) -> DataFrame:
    """level, file_id, name, content, bloom: the raw files of a log with columns level and file_id. A file must fit a task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        level, number, entries = int(rows["level"].iloc[0]), int(rows["file_id"].iloc[0]), _plain(rows)
        return pd.DataFrame({"level": [level], "file_id": [number], "name": [f"sst-{number}-L{level}.sst"], "content": [table_bytes(entries, block_rows)], "bloom": [bloom_bytes((r[0] for r in entries), bits_per_key)]})

    return log.groupBy("level", "file_id").applyInPandas(run, "level int, file_id long, name string, content binary, bloom binary")


def decode(encoded: DataFrame, tables: bool = True) -> DataFrame:
    """Rows of the column content: of sorted tables, or of frames of a log."""
    parse = table_rows if tables else wal_rows

    def run(frames):
        for held in frames:
            for content in held["content"]:
                yield pd.DataFrame(parse(bytes(content)), columns=COLUMNS)

    return encoded.select("content").mapInPandas(run, LOG_DDL)


def write_tables(log: DataFrame, folder: str, block_rows: int = 128, bits_per_key: int = 10) -> list[str]:
    """Raw table and filter files in a folder of any Hadoop file system, one pair after the other; their names."""
    jvm, conf = log.sparkSession._jvm, log.sparkSession._jsc.hadoopConfiguration()
    names = []
    for row in encode_tables(log, block_rows, bits_per_key).toLocalIterator():  # a file at a time
        for name, data in ((row["name"], row["content"]), (row["name"] + ".bf", row["bloom"])):
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            out = path.getFileSystem(conf).create(path, False)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
            names.append(name)
    return sorted(names)
