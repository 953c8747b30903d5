"""N-gram Jaccard join: documents whose sets of 5-word shingles have a similarity of 3/4 or more.

1. Profile: each text's set in one number (equal sets are one class from here on), and a sketch of bounded size
   that counts all shingles of all texts.
2. Prefixes: a set's rarest shingles, by the sketch, as many as must hold a common one for a link, are dealt by
   shingle. Sets that meet at a shingle are candidates unless the length or the position filter excludes them.
3. Verification: candidates, each pair once, are first compared by their sets' parities (a bit or two a shingle):
   each that differs is a shingle of one set alone, so too many exclude a link. What is left is compared whole,
   after the suffix filter (hash ranges of what lies behind the prefix). Texts travel compressed; only those of
   candidates that are left travel at all.
4. Components over the links. Where many sets meet at one shingle, only neighbours by size are candidates at
   first; if that leaves several components at the shingle, the sets outside its largest one are compared with
   all of the others there, in blocks, by parities and then by texts. So no link between components is lost, and a group of near copies is
   not expanded into its pairs. A shingle with more sets than a task should hold goes straight to that step; a
   wrong guess about which ones these are costs time, never a link.

Tables on the way are removed from the shared folder when the result has been made.

Rules for odd input: null, empty and wordless texts have an empty set and link with nothing; very long texts are
taken whole, each in the memory of one task; a null doc_id is never a component's id while another is reachable
(else the id is null); repeated rows each give a row; equally common shingles go by hash; component ids are the
smallest doc_id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import alone, input_columns, materialize, release, scratch, unused
from .components import components

#: Postings of one bucket (24 bytes each), of which a task holds at most HOLD buckets' worth at once.
BUCKET_POSTINGS = 1 << 18
HOLD = 4
#: Sets that may meet at a shingle before it counts as crowded, and the neighbours that each then meets at first.
CROWD = 32
NEIGHBOURS = 2
#: Sets compared with each other in one task of the last step.
BLOCK_SETS = 500
#: Ids of candidate texts up to which they are sent to every task (16 bytes each); beyond, the join is a shuffle.
BROADCAST_IDS = 2_000_000
CHUNK = 1 << 14

POSTING = np.dtype([("shingle", "<u8"), ("set", "<i8"), ("size", "<u4"), ("pos", "<u4")])
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("crowd", pa.bool_())])


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return input_columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _sets(batch: pa.RecordBatch, column: str = "text"):
    return (sh.shingles(t) for t in batch.column(column).cast(pa.binary()).to_pylist())


def profile(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """doc_id, n_shingles, set_id (null for an empty set), parities of every document, and the sketch over all shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("parities", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
    docs = _named(docs, doc_id, text)
    n_docs, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    bits = max(sh.sketch_bits(n_docs), sh.sketch_bits_of_text(size or 0))

    def run(batches):
        alone()
        sketch = np.zeros((sh.SKETCH_ROWS, 1 << bits), np.uint32)
        for batch in batches:
            sizes, ids, marks, held, n = [], [], [], [], 0

            def add():
                cells = sh.sketch_cells(np.concatenate(held), bits)
                for r in range(sh.SKETCH_ROWS):
                    sketch[r] += np.bincount(cells[r], minlength=1 << bits).astype(np.uint32)

            for s in _sets(batch):
                sizes.append(len(s))
                ids.append(sh.set_id(s) if len(s) else None)
                marks.append(sh.parities(s) if len(s) else None)
                held.append(s)
                n += len(s)
                if n >= 1 << 20:
                    add()
                    held, n = [], 0
            if held:
                add()
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=schema)
            release()
        flat = sketch.reshape(-1, CHUNK)
        used = np.flatnonzero(flat.any(1)).tolist()
        for k in range(0, len(used), 64):
            some = used[k : k + 64]
            none = [None] * len(some)
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n_shingles": none, "set_id": none, "parities": none, "chunk": some, "counts": [narrow(flat[c]) for c in some]}, schema)

    both = materialize(docs.mapInArrow(run, "doc_id long, n_shingles long, set_id long, parities binary, chunk int, counts binary"), "profile", keep=True)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, f"<u{len(raw) // CHUNK}").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"chunk": list(sums), "counts": [v.astype("<i8").tobytes() for v in sums.values()]}, pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    sketch = np.zeros(sh.SKETCH_ROWS << bits, np.int64).reshape(-1, CHUNK)
    sums = both.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(total, "chunk int, counts binary")
    for row in sums.collect():  # the sketch: at most 2 x 2^22 counters
        sketch[row["chunk"]] = np.frombuffer(row["counts"], "<i8")
    sketch = np.minimum(sketch, (1 << 31) - 1).astype(np.int32).reshape(sh.SKETCH_ROWS, -1)
    return both.where("chunk is null").select("doc_id", "n_shingles", "set_id", "parities"), sketch


def narrow(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(counts.max()).newbyteorder("<")).tobytes()


def hot_limits(sketch: np.ndarray) -> np.ndarray:
    """For each row of the sketch, the count above which a shingle goes past the buckets.

    A quarter of a bucket above the row's mean, or more where one counter in a thousand is larger: so a large input
    does not send all its shingles that way.
    """
    return np.array([max(int(row.mean()) + BUCKET_POSTINGS // 4, int(np.quantile(row, 0.999))) for row in sketch])


def postings(docs: DataFrame, sketch: np.ndarray, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The prefixes of all sets, dealt into buckets by shingle, as packed arrays; a set once a task however many copies it has.

    Shingles that the sketch takes to be hot are dealt by set into as many buckets more, which are passed on
    untouched. The sketch also counts copies and what shares a counter, so some of them have few sets.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        order, seen = sent.value, set()
        limits = hot_limits(order)[:, None]
        for batch in batches:
            made, n = [], 0

            def flush():
                rows = np.concatenate(made)
                hot = (sh.estimates(rows["shingle"], order) > limits).all(0)
                bucket = sh.mix(np.where(hot, rows["set"].view(np.uint64), rows["shingle"])) % np.uint64(buckets) + np.where(hot, np.uint64(buckets), np.uint64(0))
                rows = rows[np.argsort(bucket, kind="stable")]
                ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=2 * buckets))
                used = np.flatnonzero(np.diff(ends, prepend=0))
                parts = [rows[ends[b - 1] if b else 0 : ends[b]].tobytes() for b in used.tolist()]
                return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "rows"])

            for s in _sets(batch):
                if not len(s) or (key := sh.set_id(s)) in seen:
                    continue
                seen.add(key)
                p = sh.prefix_size(len(s))
                one = np.empty(p, POSTING)
                one["shingle"], one["set"], one["size"], one["pos"] = sh.rare_first(s, order)[:p], key, len(s), np.arange(p)
                made.append(one)
                n += p
                if n >= 1 << 20:
                    yield flush()
                    made, n = [], 0
            if made:
                yield flush()
            made = []
            release()

    return _named(docs, doc_id, text).select("text").mapInArrow(run, "bucket long, rows binary")


class Bucket:
    """The postings of one bucket as they come, in bounded memory: a shingle with too many of them is passed on as crowded."""

    def __init__(self, passes: bool):
        self.passes = passes
        self.held: list[np.ndarray] = []
        self.n, self.limit = 0, HOLD * BUCKET_POSTINGS
        self.gone = np.empty(0, np.uint64)

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Take postings; give those that are crowded already."""
        if self.passes:
            return rows
        out = np.isin(rows["shingle"], self.gone) if len(self.gone) else np.zeros(len(rows), bool)
        crowd = [rows[out]]
        self.held.append(rows[~out])
        self.n += len(self.held[-1])
        if self.n > self.limit:
            rows = np.concatenate(self.held)
            which, count = np.unique(rows["shingle"], return_counts=True)
            more = which[count > BUCKET_POSTINGS // 4]
            self.gone = np.union1d(self.gone, more)
            out = np.isin(rows["shingle"], more)
            crowd.append(rows[out])
            self.held, self.n = [rows[~out]], int((~out).sum())
            self.limit = max(self.limit, 2 * self.n)
        return np.concatenate(crowd)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        return meet(np.concatenate(self.held) if self.held else np.empty(0, POSTING))


def meet_all(dealt: DataFrame, buckets: int) -> DataFrame:
    """(a, b) of candidate pairs, or set and shingle of crowded postings (crowd), of all buckets."""

    def rows_of(pairs: np.ndarray, crowd: np.ndarray) -> pa.RecordBatch:
        a, b = np.concatenate([pairs[:, 0], crowd["set"]]), np.concatenate([pairs[:, 1], crowd["shingle"].view(np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.repeat([False, True], [len(pairs), len(crowd)]))], schema=MET)

    def run(batches):
        none, now, bucket = np.empty((0, 2), np.int64), None, None
        for batch in batches:
            for which, raw in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if which != now:
                    if bucket:
                        yield rows_of(*bucket.finish())
                    now, bucket = which, Bucket(which >= buckets)
                crowd = bucket.add(np.frombuffer(raw, POSTING))
                if len(crowd):
                    yield rows_of(none, crowd)
        if bucket:
            yield rows_of(*bucket.finish())
        release()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, crowd boolean")


def meet(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's postings: the candidate pairs (two columns, less first, distinct), and the postings at crowded shingles."""
    none = np.empty((0, 2), np.int64), rows[:0]
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows["set"], rows["size"], rows["shingle"]))]
    same = (rows["shingle"][1:] == rows["shingle"][:-1]) & (rows["set"][1:] == rows["set"][:-1])
    rows = rows[np.concatenate(([True], ~same))]  # a set that several tasks dealt
    first = np.flatnonzero(np.concatenate(([True], rows["shingle"][1:] != rows["shingle"][:-1])))
    length = np.diff(np.append(first, len(rows)))
    end, length = np.repeat(first + length, length), np.repeat(length, length)
    keep = np.flatnonzero(length > 1)
    rows = rows[keep]
    if not len(rows):
        return none
    place = np.cumsum(np.ones(len(keep), np.int64)) - 1
    end, length = place + (end[keep] - keep), length[keep]  # within the kept rows
    crowded = length > CROWD
    reach = np.where(crowded, NEIGHBOURS, CROWD)
    size, pos = rows["size"].astype(np.int64), rows["pos"].astype(np.int64)
    pairs, i, d = [], place, 0
    while True:
        d += 1
        i = i[(i + d < end[i]) & (d <= reach[i])]
        if not len(i):
            break
        j = i + d
        near = 4 * size[i] >= 3 * size[j]  # length; sizes ascend at a shingle
        near &= 7 * (1 + np.minimum(size[i] - pos[i], size[j] - pos[j]) - 1) >= 3 * (size[i] + size[j])  # position
        a, b = rows["set"][i[near]], rows["set"][j[near]]
        pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    return np.unique(np.concatenate(pairs), axis=0) if pairs else none[0], rows[crowded]


def suffix_differs(a: np.ndarray, b: np.ndarray, ranges: int = 16) -> bool:
    """True if the sets' numbers of hashes by range alone exclude a link."""
    bounds = (np.arange(1, ranges, dtype=np.uint64)) << np.uint64(60)
    x, y = (np.diff(np.concatenate(([0], np.searchsorted(s, bounds), [len(s)]))) for s in (a, b))
    return 7 * int(np.minimum(x, y).sum()) < 3 * (len(a) + len(b))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, which is 7 * intersection >= 3 * (sum of sizes)."""
    total = 3 * (len(a) + len(b))
    if not total or 7 * min(len(a), len(b)) < total or suffix_differs(a, b):
        return False
    return 7 * len(np.intersect1d(a, b, assume_unique=True)) >= total


def packed(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b" ".join(text.split()))


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def candidate_texts(docs: DataFrame, sets: DataFrame, reps: DataFrame, repeated: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """set_id, packed text of one document of each wanted set. repeated: whether some doc_id has several rows."""
    wanted = reps.join(sets, "set_id", "left_semi").select("set_id", F.col("any_id").alias("doc_id"))
    wanted = materialize(wanted, "wanted")
    small = wanted.count() <= BROADCAST_IDS

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for key, t in zip(batch.column("set_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if sh.set_id(sh.shingles(t)) == key:  # repeated doc_ids can have several texts
                    ids.append(key)
                    out.append(packed(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["set_id", "z"])
            release()

    named = _named(docs, doc_id, text).where("text is not null")
    joined = named.join(F.broadcast(wanted) if small else wanted, named["doc_id"].eqNullSafe(wanted["doc_id"])).select("set_id", "text")
    found = joined.mapInArrow(run, "set_id long, z binary")
    return materialize(found.groupBy("set_id").agg(F.first("z").alias("z")) if repeated else found, "texts")


def near(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) that parities do not exclude. marks: set_id, n, parities."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "nb", "pa", "pb")]
            ok = [7 * sh.differing(x, y) <= n + m for n, m, x, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    marks = marks.hint("merge")
    left = pairs.join(marks.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("parities").alias("pa")), "a")
    return left.join(marks.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("parities").alias("pb")), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches):
        for batch in batches:
            ok = [linked(sh.shingles(unpacked(x)), sh.shingles(unpacked(y))) for x, y in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
            release()

    texts = texts.hint("merge")  # they grow with the input: never broadcast, and alike at every size
    left = pairs.join(texts.select(F.col("set_id").alias("a"), F.col("z").alias("za")), "a")
    return left.join(texts.select(F.col("set_id").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def block_links(ids: list[int], blocks: list[int], roots: list[int], texts: list[bytes], lo: int, hi: int) -> list[tuple[int, int]]:
    """Links between different components among the sets of two blocks (or of one, lo == hi), as many as join them up."""
    count: dict[int, int] = {}
    for r in roots:
        count[r] = count.get(r, 0) + 1
    largest = max(count, key=lambda r: (count[r], r))
    parent = {r: r for r in count}

    def find(r):
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    if len(count) == 1:
        return []
    sets = [sh.shingles(unpacked(t)) for t in texts]
    sizes, owner = np.array([len(s) for s in sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i in range(len(sets)):
        if roots[i] == largest:
            continue
        a, b = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = b - a
        who = owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
        common = np.bincount(who, minlength=len(sets))
        for j in np.flatnonzero(7 * common >= 3 * (sizes + sizes[i])).tolist():
            if lo != hi and blocks[i] == blocks[j]:
                continue
            x, y = find(roots[i]), find(roots[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def block_near(blocks: np.ndarray, roots: np.ndarray, sizes: np.ndarray, marks: list[bytes], lo: int, hi: int) -> np.ndarray:
    """Which sets of two blocks (or of one, lo == hi) have another, in another component, that parities do not exclude."""
    keep, width = np.zeros(len(marks), bool), np.array([len(m) for m in marks])
    held = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        held[w] = at, np.frombuffer(b"".join([marks[i] for i in at.tolist()]), "<u8").reshape(len(at), -1)
    for w, (at, bits) in held.items():
        for to, other in ((at, bits), (held[2 * w][0], sh.folded(held[2 * w][1])) if 2 * w in held else (at[:0], bits[:0])):
            if not len(to):
                continue  # linked sets' sizes differ by a third at most, so their widths by one step
            step = max(1, (4 << 20) // other.nbytes)
            for k in range(0, len(at), step):
                i = at[k : k + step]
                differ = np.bitwise_count(bits[k : k + step, None] ^ other[None]).sum(-1, dtype=np.int64)
                ok = (7 * differ <= sizes[i][:, None] + sizes[to]) & (roots[i][:, None] != roots[to])
                if lo != hi:
                    ok &= blocks[i][:, None] != blocks[to]
                keep[i] |= ok.any(1)
                keep[to] |= ok.any(0)
    return keep


def crowd_links(crowded: DataFrame, roots: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that are missing between components that meet at a crowded shingle. crowded: shingle, set_id.

    A shingle's largest component has blocks of its own, which never meet each other: with few sets outside it,
    the work grows with the number of sets there, not with its square.
    """
    labelled = crowded.distinct().join(roots, "set_id", "left").select("shingle", "set_id", F.coalesce("root", "set_id").alias("root"))
    labelled = materialize(labelled, "crowded")
    sizes = labelled.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    about = sizes.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    blocks = lambda n: F.ceil(n / BLOCK_SETS).cast("int")
    about = about.select("shingle", F.col("top.root").alias("top"), blocks(F.col("n") - F.col("top.n")).alias("others"), blocks(F.col("top.n")).alias("tops"))
    dealt = labelled.join(about, "shingle")
    in_top, spot = F.col("root") == F.col("top"), F.xxhash64("set_id")
    dealt = dealt.withColumn("block", F.when(in_top, F.col("others") + F.pmod(spot, F.col("tops"))).otherwise(F.pmod(spot, F.col("others"))).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.when(in_top, F.col("others") - 1).otherwise(F.col("others") + F.col("tops") - 1)))
    pairs = dealt.withColumn("other", partner).select("shingle", F.least("block", "other").alias("lo_block"), F.greatest("block", "other").alias("hi_block"), "block", "set_id", "root")
    columns = ["shingle", "lo_block", "hi_block", "block", "set_id", "root"]

    def sift(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        kept = block_near(*(group[c].to_numpy() for c in ("block", "root", "n")), group["parities"].tolist(), key[1], key[2])
        return group.loc[kept, columns]

    left = pairs.join(marks.hint("merge"), "set_id").groupBy(*columns[:3]).applyInPandas(sift, "shingle long, lo_block int, hi_block int, block int, set_id long, root long")
    rows = materialize(left, "crowded-near").join(texts.hint("merge"), "set_id")

    def run(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("set_id", kind="stable")
        found = block_links(group["set_id"].tolist(), group["block"].tolist(), group["root"].tolist(), group["z"].tolist(), key[1], key[2])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("shingle", "lo_block", "hi_block").applyInPandas(run, "a long, b long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, set_id) and links (a, b) between sets.

    The links are a connecting subset, not all pairs of similar sets: every component is whole, but at crowded
    shingles pairs inside a component are left out, so links of a document must not be counted from them.
    """
    about, sketch = profile(docs, doc_id, text)  # the sketch has a bounded size
    kept = about.where("set_id is not null")
    reps = materialize(kept.groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("any_id"), F.first("parities").alias("parities")), "sets")
    marks = reps.select("set_id", "n", "parities")
    total = reps.agg(F.sum(F.expr("n - (3 * n + 3) div 4 + 1")).alias("p")).first()["p"] or 0
    buckets = max(1, -(-total // BUCKET_POSTINGS))

    met = materialize(meet_all(postings(docs, sketch, buckets, doc_id, text), buckets), "met")
    pairs = materialize(near(met.where("not crowd").select("a", "b").distinct(), marks), "pairs")
    crowded = met.where("crowd").select(F.col("a").alias("set_id"), F.col("b").alias("shingle"))
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(crowded.select("set_id")).distinct()
    repeated = bool(kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").take(1))
    texts = candidate_texts(docs, wanted, reps, repeated, doc_id, text)
    links = materialize(verify(pairs, texts), "links")
    if crowded.take(1):
        more = materialize(crowd_links(crowded, components(links), marks, texts), "links-more")
        links = links.unionByName(more)
    return about, links


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    with scratch(docs.sparkSession):
        about, links = join(docs, doc_id, text)
        least = about.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        roots = components(links)
        rooted = least.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        rooted = materialize(rooted.where("n > 1 or root <> set_id or least is null").select("set_id", "root", "least").unionByName(roots.where("root = set_id").join(least, "set_id").select("set_id", "root", "least")).distinct(), "classes")
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        member = materialize(rooted.join(ids, "root").select("set_id", "component_id"), "members", keep=True)
    return about.join(member, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; all columns stay.

    Where some doc_id is null or repeated, rows are numbered and the first row of each component stays.
    """
    ids = docs.select(F.col(f"`{doc_id}`").alias("i"))
    odd = ids.where("i is null").take(1) or ids.groupBy("i").count().where("count > 1").take(1)
    key = unused(docs, "join_row") if odd else doc_id
    with scratch(docs.sparkSession):
        rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "join-docs", keep=True) if odd else docs
        gone = materialize(cluster(rows, key, text).where("component_id <> doc_id").select(F.col("doc_id").alias(key)), "join-gone", keep=True)
    out = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
