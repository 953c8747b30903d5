"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark text, one scan of each document.

Words are lower-cased (A-Z) runs of digits, a-z and anything beyond ASCII. A window is ten consecutive words of
an item; an item of fewer words, but at least one, is a single window. It reads each
word as three letters. Its patterns are one anchor for each window: the longest three of its words in a row (or all, if it has fewer), which
neighbouring windows mostly share. Where an anchor occurs in a text, the whole windows that it stands for are
compared by 64-bit hash. Hits are word numbers, and their spans are mapped to code points of the original text.

The benchmark goes by way of the shared folder, from tasks to tasks, in blocks of at most BLOCK_BYTES of words;
each block is one automaton and one scan of the documents. A block's automaton takes about 15 bytes for each of its bytes
(a 20 MB benchmark: about 350 MB in each Python worker).

Rules for odd input: null or wordless texts have no words and no hits; very long texts are scanned whole, in one
task's memory, and very long items are cut into pieces that hold the same windows; an item without an id marks
words but is not named; items that repeat an id count once; where windows overlap, a word is hit once; repeated
documents each give a row; an empty benchmark leaves every document clean; an empty table gives no rows; columns
other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, filesystem, fresh_path, input_columns, keep_rows, keeps, materialize, register, release, scratch

WINDOW = 10
#: Words of a window that stand for it in the automaton.
ANCHOR = 3
#: Normalised benchmark text of one automaton; a larger benchmark is scanned for in blocks.
BLOCK_BYTES = 21 << 20
#: Words of one piece of a long item.
PIECE_WORDS = 10_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

HITS = "row_id long, doc_id long, n_words long, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text; other white space than ASCII's is part of words."""
    return text.translate(_NORMAL).split()


def _code(i: int) -> str:
    """The i-th word in the automaton's alphabet: three letters out of 64 each, so that no node has many branches, and of
    different ones each, so that matches start at words. Beyond 2^18, codes repeat."""
    return "".join(chr(1 + 64 * k + (i >> 6 * k & 63)) for k in range(3))


def windows_of(text: bytes, window: int):
    """Hash, anchor, and way, of each window of some words: how many words back from its anchor's last one it starts, and its size."""
    words = text.split()
    n = min(window, len(words))
    k = min(ANCHOR, n)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    begins = [0, *ends]
    rank = [(begins[i] - ends[i + k - 1], text[begins[i] : ends[i + k - 1] - 1]) for i in range(len(words) - k + 1)]
    best = -1
    for i in range(len(words) - n + 1 if n else 0):
        last = i + n - k
        if best < i:
            best = min(range(i, last + 1), key=rank.__getitem__)
        elif rank[last] < rank[best]:
            best = last
        yield xxhash.xxh3_64_intdigest(text[begins[i] : ends[i + n - 1] - 1]), rank[best][1], (best - i + k - 1, n)


class Matcher:
    """Windows of a benchmark (hash and item id), found in texts by an automaton over their anchors (words and ways)."""

    def __init__(self, hashes: pa.Array, items: pa.Array, anchors: pa.Array, ways: pa.Array):
        keys, owner = hashes.to_numpy().view(np.uint64), items.dictionary_encode("encode")
        who = owner.indices.to_numpy()
        order = np.lexsort((who, keys))
        self.items, self.owners = owner.dictionary.to_pylist(), who[order]
        self.hashes, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.codes: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton() if len(keys) else None
        which = ways.dictionary_encode()
        known = [tuple(tuple(map(int, w.split(":"))) for w in x.split(",")) for x in which.dictionary.to_pylist()]
        get, put = self.codes.get, self.codes.setdefault
        for text, i in zip(anchors.to_pylist(), which.indices.to_pylist(), strict=True):
            key = "".join([get(w) or put(w, _code(len(self.codes))) for w in text.split(b" ")])
            self.machine.add_word(key, self.machine.get(key, ()) + known[i])  # another anchor has the key where codes repeat
        if self.machine:
            self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words, and number among the hashes, of each window of the benchmark in a text."""
        none = np.empty(0, np.int64)
        if self.machine is None or not words:
            return none, none, none
        n, starts, sizes = len(words), [], []
        for end, ways in self.machine.iter("".join(map(self.codes.get, words, itertools.repeat("\0\0\0")))):
            for back, size in ways:
                if 0 <= end // 3 - back <= n - size:
                    starts.append(end // 3 - back)
                    sizes.append(size)
        if not starts:
            return none, none, none
        found = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[s : s + z])) for s, z in zip(starts, sizes, strict=True)), np.uint64, len(starts))
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        ok = self.hashes[at] == found
        return np.array(starts)[ok], np.array(sizes)[ok], at[ok]

    def scan(self, text: bytes) -> tuple[int, list[int], list[str]]:
        """Number of words, the hit ones, and the ids of items whose windows occur."""
        words = words_of(text)
        starts, sizes, at = self.hits(words)
        if not len(starts):
            return len(words), [], []
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + sizes, -1)
        who = {int(o) for k in np.unique(at).tolist() for o in self.owners[self.first[k] : self.first[k + 1]]}
        return len(words), np.flatnonzero(np.cumsum(steps)).tolist(), sorted(i for i in map(self.items.__getitem__, who) if i is not None)


class Blocks(NamedTuple):
    """The windows and anchors of a benchmark, in the shared folder, in so many blocks."""

    path: str
    n: int


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_id: str = "item_id", item_text: str = "text") -> Blocks:
    """Write a benchmark's windows and anchors, dealt by hash of their piece of an item into blocks; at least one block."""
    spark = benchmark.sparkSession
    items = input_columns(benchmark, item_id=item_id, text=item_text).select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    schema = pa.schema([("block", pa.int32()), ("item_id", pa.string()), ("hash", pa.int64()), ("anchor", pa.binary()), ("way", pa.string())])

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text or b"")
                for k in range(0, max(len(words) - window + 1, min(1, len(words))), PIECE_WORDS):
                    piece = b" ".join(words[k : k + PIECE_WORDS + window - 1])
                    hashes, anchors, ways = zip(*windows_of(piece, window), strict=True)
                    n, block = len(hashes), xxhash.xxh3_64_intdigest(piece, seed=1) % blocks
                    yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), pa.array([item] * n, pa.string()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(anchors, pa.binary()), pa.array([f"{a}:{b}" for a, b in ways])], schema=schema)

    with scratch(spark):
        found = materialize(items.distinct().mapInArrow(cut, "block int, item_id string, hash long, anchor binary, way string"), "benchmark")
        path = register(fresh_path(spark, "benchmark-blocks"), keep=True)
        found.select("block", "item_id", "hash").distinct().repartition(blocks, "block").write.partitionBy("block").parquet(f"{path}/windows")
        anchors = found.groupBy("block", "anchor").agg(F.array_join(F.array_sort(F.collect_set("way")), ",").alias("ways"))
        anchors.repartition(blocks, "block").write.partitionBy("block").parquet(f"{path}/anchors")
    return Blocks(path, blocks)


@functools.lru_cache(maxsize=1)
def matcher(blocks: Blocks, block: int) -> Matcher:
    """A block's matcher, kept by a worker until it needs another."""

    def columns(kind: str, **kinds):
        fs, path = filesystem(f"{blocks.path}/{kind}/block={block}")
        if fs.get_file_info(path).type.name == "NotFound":  # nothing was dealt to it
            return [pa.array([], k) for k in kinds.values()]
        found = ds.dataset(path, pa.schema(list(kinds.items())), format="parquet", filesystem=fs).to_table()
        return [found.column(c).combine_chunks() for c in kinds]

    made = Matcher(*columns("windows", hash=pa.int64(), item_id=pa.string()), *columns("anchors", anchor=pa.binary(), ways=pa.string()))
    release()
    return made


keeps("decontaminate", matcher.cache_clear)


def spans_of(text: str, words: list[int]) -> list[dict]:
    """Code-point spans of runs of the given words (ascending numbers) in the original text."""
    out, wanted, k, last = [], words, 0, -2
    for i, m in enumerate(_WORD_ANY_CASE.finditer(text)):
        if k == len(wanted):
            break
        if i == wanted[k]:
            if last == i - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last, k = i, k + 1
    return out


def _placed(text: bytes | None, hit: list[int]) -> list[dict]:
    return spans_of(text.decode("utf-8", "surrogateescape"), hit) if hit else []


def _scan_block(docs: DataFrame, blocks: Blocks, block: int, spans: bool) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), _SPANS]

    def run(batches):
        alone("decontaminate")
        for batch in batches:
            rows = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for row, doc, text in zip(batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                n, hit, who = matcher(blocks, block).scan(text or b"")
                rows.append((row, doc, n, hit, who, _placed(text, hit) if spans else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds, strict=True)], names=["row_id", "doc_id", "n_words", "hit_words", "items", "spans"])
            release()

    return docs.mapInArrow(run, HITS)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs; all columns stay."""
    blocks = blocks_of(benchmark, window, block_bytes)
    for block in range(blocks.n):

        def wanted(batch, block=block):
            found = matcher(blocks, block)
            return pa.array([not len(found.hits(words_of(t or b""))[0]) for t in batch.column(text).cast(pa.binary()).to_pylist()], pa.bool_())

        docs = keep_rows(docs, wanted, "decontaminate")
        if block + 1 < blocks.n:  # so that a task never holds two automata
            docs = materialize(docs, "decontaminate-kept")
    return docs


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", spans: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, hit_words (their numbers), items (ids with occurring windows, sorted), spans.

    With more than one block the texts are scanned once for each, and a document's hits are merged.
    """
    named = input_columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = blocks_of(benchmark, window, block_bytes, item_id, item_text)
    if blocks.n == 1:
        return _scan_block(named.withColumn("row_id", F.lit(0).cast("long")), blocks, 0, spans).drop("row_id")
    numbered = materialize(named.withColumn("row_id", F.monotonically_increasing_id()), "decontaminate-docs")
    some = F.size("hit_words") > 0
    # Each block's hits are kept as a table, so a block's automaton is gone before the next; the first keeps a row for every text.
    scans = [_scan_block(numbered, blocks, block, False) for block in range(blocks.n)]
    tables = [materialize(scan.where(some) if block else scan, "decontaminate-hits") for block, scan in enumerate(scans)]
    merged = functools.reduce(DataFrame.unionByName, tables).groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = materialize(merged, "decontaminate-merged")

    def place(batches):
        for batch in batches:
            found = [_placed(t, h) if spans else [] for t, h in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("hit_words").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "hit_words", "items")), pa.array(found, _SPANS)], names=["doc_id", "n_words", "hit_words", "items", "spans"])

    columns = ["doc_id", "n_words", "hit_words", "items"]
    hit = merged.where(some).join(numbered.select("row_id", "text"), "row_id").select(*columns, "text").mapInArrow(place, HITS.removeprefix("row_id long, "))
    return merged.where(~some).select(*columns, F.array().cast("array<struct<start:int,end:int>>").alias("spans")).unionByName(hit)


def digest(hits: DataFrame) -> DataFrame:
    """The result in counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def words(text: str | None) -> list[str]:
    """The words of a text, as the automaton sees them (for tests and small data)."""
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return _WORD.findall(low)


def sha256_of(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
