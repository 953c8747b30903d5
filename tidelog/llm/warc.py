"""WARC archives, read back by boundary-chain verification.

Tasks scan blocks of the files for record magic and emit, for each candidate, its successor: where its record
would end. Inside a block a task follows its candidates to the first place beyond the block, so each candidate
points over the whole block; pointer jumping from the file's start then doubles these pointers and keeps what
is reachable. Magic inside a payload is a candidate too, but nothing reachable points at it.

Files are plain (.warc) or have each record in a gzip member of its own (.warc.gz); in the latter the magic is
that of gzip, and a candidate that does not inflate to a record has no successor.

Rules for odd input: null html is an empty payload, null url an empty target; a null page_id is written without
an id, is never referred to, and repeats another page's payload as any page does; rows with one page_id and one
payload are all responses if that is the largest; an empty table gives no files and no rows; other columns are
ignored. A file whose chain does not end at its end raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, input_columns, materialize, spread, write_file

#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
READ_BYTES = 1 << 20
VERSION = b"WARC/1.1"
MAGIC = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
ID = "urn:page:"

RECORDS = "path string, at long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, target string"


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record. A revisit has no block; size and digest are of the full payload either way."""
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Date: 2024-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{ID}{page_id}>".encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url).encode("utf-8", "replace"))
    head.append(b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)))
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>".encode(), f"X-Payload-Length: {size}".encode()]
    body = b"" if kind == "revisit" else payload
    return b"\r\n".join([*head, b"Content-Length: %d" % len(body), b"", b""]) + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name; None if this is no record's header."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(MAGIC):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() else None


def _page(value: str | None) -> int | None:
    return int(value.strip("<>").removeprefix(ID)) if value and value.strip("<>").startswith(ID) else None


class Records:
    """Sequential and random access to the records of one file, in bounded memory but for a header and, on request, a payload."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.gzip = self.file.read_at(3, 0) == GZIP

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _inflated(self, at: int, ends: list[int]):
        """Chunks of the gzip member at a place; its end goes to ends."""
        inflate, place, wanted = zlib.decompressobj(31), at, 4096
        while not inflate.eof:
            raw = self.file.read_at(wanted, place)
            if not raw:
                raise zlib.error("the member does not end")
            place, wanted = place + len(raw), READ_BYTES
            while raw and not inflate.eof:
                yield inflate.decompress(raw, READ_BYTES)
                raw = inflate.unconsumed_tail
        ends.append(place - len(inflate.unused_data))

    def _plain(self, at: int):
        wanted = 4096
        while raw := self.file.read_at(wanted, at):
            yield raw
            at, wanted = at + len(raw), READ_BYTES

    def read(self, at: int, payload: bool = False) -> tuple[int, dict[str, str], bytes, str] | None:
        """Successor, header, payload (if wanted) and its SHA-1 of the record at a place; None if there is none."""
        ends: list[int] = []
        chunks = self._inflated(at, ends) if self.gzip else self._plain(at)
        held = b""
        try:
            for chunk in chunks:
                held += chunk
                if not held.startswith(MAGIC[: len(held)]):
                    return None
                if b"\r\n\r\n" in held or len(held) > READ_BYTES:
                    break
            head, found, rest = held.partition(b"\r\n\r\n")
            fields = parse_head(head) if found else None
            if fields is None:
                return None
            left, kept = int(fields["content-length"]), []
            if not self.gzip:
                end = at + len(head) + 4 + left + 4
                if end > self.size or self.file.read_at(4, end - 4) != b"\r\n\r\n":
                    return None
                if payload:
                    kept.append(self.file.read_at(left, at + len(head) + 4))
                return end, fields, b"".join(kept), hashlib.sha1(kept[0]).hexdigest() if payload else ""
            sha, tail = hashlib.sha1(), b""
            while True:
                body, rest = rest[:left], rest[left:]
                left -= len(body)
                if payload:
                    sha.update(body)
                    kept.append(body)
                tail += rest
                if len(tail) > 4 or (rest := next(chunks, None)) is None:
                    break
            if left or tail != b"\r\n\r\n":
                return None
            return ends[0], fields, b"".join(kept), sha.hexdigest()
        except zlib.error:
            return None

    def candidates(self, start: int, end: int) -> list[int]:
        """Places from start up to end where magic begins."""
        magic = GZIP if self.gzip else MAGIC
        raw, out, at = self.file.read_at(end - start + len(magic) - 1, start), [], -1
        while (at := raw.find(magic, at + 1)) >= 0:
            out.append(start + at)
        return out


def blocks_of(files: DataFrame, block_bytes: int) -> DataFrame:
    """path, start, size of each block of the files (path, size)."""
    return files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))).alias("start"))


def candidate_edges(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, at, successor, beyond: each candidate record, where it ends, and the first place beyond its block on its chain.

    successor is null where no record begins; beyond is null where the chain breaks off inside the block.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with Records(row["path"]) as file:
                    end = min(row["start"] + block_bytes, row["size"])
                    ats = file.candidates(row["start"], end)
                    after = {at: found[0] if (found := file.read(at)) else None for at in ats}
                beyond: dict[int, int | None] = {}
                for at in reversed(ats):
                    to = after[at]
                    beyond[at] = to if to is None or to >= end else beyond.get(to)
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(ats), pa.string()), *(pa.array([f(a) for a in ats], pa.int64()) for f in (int, after.get, beyond.get))], names=["path", "at", "successor", "beyond"])

    return spread(blocks_of(files, block_bytes), "path", "start").mapInArrow(run, "path string, at long, successor long, beyond long")


def reachable(files: DataFrame, edges: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, at: the first record on the chain in each block that the chain from the file's start enters, and the file's end."""
    spark = files.sparkSession
    largest = files.agg(F.max("size")).first()[0] or 0
    reach = files.select("path", F.lit(0).cast("long").alias("at"))
    # Chains in a block soon run together, so few candidates are where one from an earlier block lands; only these can be entered.
    landed = edges.where("beyond is not null").select("path", F.col("beyond").alias("at")).unionByName(reach).distinct()
    jump = materialize(edges.where("beyond is not null").join(landed, ["path", "at"], "left_semi").select("path", "at", F.col("beyond").alias("to")), "jump")
    hops = max(1, -(-largest // block_bytes))  # blocks that a chain can enter
    for step in range(hops.bit_length()):
        reach = materialize(reach.unionByName(reach.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))).distinct(), "reach")
        if step + 1 < hops.bit_length():
            far = jump.select("path", F.col("at").alias("to"), F.col("to").alias("end"))
            jump = materialize(jump.join(far, ["path", "to"]).select("path", "at", F.col("end").alias("to")).unionByName(jump).groupBy("path", "at").agg(F.max("to").alias("to")), "jump")
    broken = files.join(reach, [files["path"] == reach["path"], files["size"] == reach["at"]], "left_anti").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['path']}: the chain of records does not reach the end")
    return spark.read.parquet(*reach.inputFiles()) if reach.inputFiles() else reach


def read_warc(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of the files (path, size) that are reachable from a file's start. Payloads are checked against their digests."""
    entries = reachable(files, materialize(candidate_edges(files, block_bytes), "edges"), block_bytes)
    entries = materialize(entries.join(files.select("path", "size"), "path").where("at < size"), "entries")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out, at = [], row["at"]
                end = min(row["size"], (at // block_bytes + 1) * block_bytes)
                with Records(row["path"]) as file:
                    while at < end:
                        after, head, payload, sha = file.read(at, payload=True)
                        kind = head["warc-type"]
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in head else sha
                        if kind == "response" and digest != sha:
                            raise ValueError(f"{row['path']} at {at}: the payload's digest is wrong")
                        size = int(head.get("x-payload-length", len(payload)))
                        out.append((row["path"], at, kind, _page(head.get("warc-record-id")), _page(head.get("warc-refers-to")), size, digest, head.get("warc-target-uri")))
                        at = after
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=[f.split()[0] for f in RECORDS.split(", ")])

    return spread(entries, "path", "at").mapInArrow(run, RECORDS)


def write_warc(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, compress: bool = True, file_bytes: int = FILE_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per page; return the files (path, size). A file counts only if it is in this table.

    Digests of payloads that occur twice or more are few against the pages; Spark joins them by broadcast while
    they are small, else by a sort-merge join that splits a hot digest.
    """
    spark = pages.sparkSession
    named = input_columns(pages, page_id=page_id, url=url, html=html).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    named = named.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    twice = named.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    # Written first, so that its size is known when the join is planned.
    twice = materialize(twice, "revisits")
    joined = named.join(twice, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    joined = joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to")
    folder = fresh_path(spark, "warc")

    def run(batches):
        held, size = [], 0

        def flush():
            uri = f"{folder}/{uuid.uuid4().hex}.warc" + ".gz" * compress
            return pa.RecordBatch.from_pydict({"path": [uri], "size": [write_file(uri, held)]}, pa.schema([("path", pa.string()), ("size", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                again = row["refers_to"] is not None
                raw = record_bytes("revisit" if again else "response", row["page_id"], row["url"], b"" if again else row["html"].encode("utf-8", "surrogatepass"), row["digest"], row["size"], row["refers_to"])
                if compress:
                    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = deflate.compress(raw) + deflate.flush()
                held.append(raw)
                size += len(raw)
                if size >= file_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialize(joined.mapInArrow(run, "path string, size long"), "warc-files")


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return digest(read_warc(write_warc(pages)))
