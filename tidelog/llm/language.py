"""Language ID by error-correcting output codes.

Each language gets a codeword; each bit has a binary logistic classifier over hashed byte n-grams (orders 1 to 4)
of the lower-cased whole text. A text's language is that of the nearest codeword by loss-weighted decoding: the
logistic loss of every bit's margin, weighted by how well the bit was learned. Texts that end about as near to a
second codeword, or far from all, are flagged as ambiguous.

Learning takes at most SAMPLE_DOCS labelled texts, chosen by a hash of doc_id, about evenly over languages.

Rules for odd input: a text that is null or without a letter (Unicode category L) gets "und", score 0, ambiguous; a
very long text is judged by all of it, in one task's memory; a row with null doc_id, lang or text is not learned from; with nothing to learn from, every text gets "und"; repeated rows each
give a row; ties go to the language first in code-point order; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_columns, keep_rows

UNKNOWN = "und"
#: Most texts that the classifiers are fitted on, over all languages.
SAMPLE_DOCS = 3000
BITS = 12
ORDERS = 4
#: Flagged: the second language's share above this, or this share of the weighted bits wrong.
SECOND, WRONG = 0.25, 0.25

_LETTER = regex.compile(r"\p{L}")
_SPACES = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Odd multipliers, one an order, that spread n-grams over the buckets.
_SPREAD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets + 1 x bits
    trust: np.ndarray  # bits


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the buckets' shares; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()) + b" "
    bytes_ = np.frombuffer(raw, np.uint8).astype(np.uint32)
    gram, total = np.zeros(len(bytes_), np.uint32), np.zeros(1 << BITS, np.int64)
    for k in range(min(ORDERS, len(bytes_))):
        gram = (gram[: len(bytes_) - k] << np.uint32(8)) | bytes_[k:]
        total += np.bincount((gram * np.uint32(_SPREAD[k]) + np.uint32(k)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(total / total.sum(), dtype=np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Exhaustive for up to seven languages; beyond, the best of 64 random codes by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1] + [1 - 2 * (b >> i & 1) for i in range(n - 1)] for b in range(1, 1 << (n - 1))]
        return np.array(columns, float).T
    rng, best, least = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = int(((code.shape[1] - code @ code.T) / 2 + np.eye(n) * width).min())
        if apart > least:
            best, least = code, apart
    return best


def fit(x: np.ndarray, languages: list[str], steps: int = 120) -> Model:
    """Logistic classifiers for all bits at once, by accelerated gradient descent; classes weigh alike."""
    names = sorted(set(languages))
    which = np.array([names.index(v) for v in languages])
    codes = codewords(len(names))
    y = codes[which]
    x = np.hstack([x * 8, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    share = np.zeros(y.shape, np.float32)
    for sign in (-1, 1):
        share += (y == sign) * (0.5 / np.maximum((y == sign).sum(0), 1))
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    v, rate = w.copy(), np.float32(0.5)
    for step in range(steps):
        ahead = w + v * np.float32(step / (step + 3))
        gradient = x.T @ (-(y * share) / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))).astype(np.float32) + 1e-5 * ahead
        new = ahead - rate * gradient
        w, v = new, new - w
    right = ((x @ w) * y > 0).mean(0)
    return Model(names, codes, w.astype(np.float32), np.maximum(2 * right - 1, 0.05))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share (0 to 1), and the flag, for rows of margins."""
    losses = np.logaddexp(0, -margins[:, None, :] * model.codes[None]) @ model.trust
    near = losses.argmin(1)
    shares = np.exp(losses.min(1, keepdims=True) - losses)
    shares /= shares.sum(1, keepdims=True)
    rows = np.arange(len(near))
    score = shares[rows, near]
    shares[rows, near] = 0
    wrong = ((margins * model.codes[near] <= 0) @ model.trust) / model.trust.sum()
    return near, score, (shares.max(1) > SECOND) | (wrong > WRONG)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on labelled texts that are not held out; None if there are none."""
    named = input_columns(docs, doc_id=doc_id, text=text, lang=lang)
    named = named.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    each, draw, wanted = max(20, sample_docs // len(counts)), F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)), F.lit(False)
    for name, n in sorted(counts.items()):
        wanted = wanted | ((F.col("lang") == name) & (draw < min(1 << 30, -(-each * (1 << 30) // n))))

    def run(batches):
        for batch in batches:
            made = [(lang, f) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if (f := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1].tobytes() for m in made], pa.binary())], names=["lang", "x"])

    rows = named.where(wanted).mapInArrow(run, "lang string, x binary").collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)  # the same model, whatever order they came in
    return fit(np.stack([np.frombuffer(x, np.float32) for _, x in rows]), [v for v, _ in rows])


def judge(texts: list, model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and flag of each text."""
    found = [features(t) for t in texts]
    langs, scores, flags = [UNKNOWN] * len(found), [0.0] * len(found), [True] * len(found)
    at = [i for i, f in enumerate(found) if f is not None] if model else []
    for k in range(0, len(at), 512):
        some = at[k : k + 512]
        x = np.stack([found[i] for i in some]) * np.float32(8)
        near, score, flag = decode((x @ model.weights[:-1] + model.weights[-1]).astype(float), model)
        for i, a, b, c in zip(some, near.tolist(), score.tolist(), flag.tolist(), strict=True):
            langs[i], scores[i], flags[i] = model.languages[a], b, c
    return langs, scores, flags


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every whole text."""
    named = input_columns(docs, doc_id=doc_id, text=text)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                langs, scores, flags = judge(part.column("text").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return named.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accept(docs: DataFrame, model: Model | None, least: float = 0.4, text: str = "text") -> DataFrame:
    """The documents that have a language: not "und", and not flagged with a score under least. All columns stay."""

    def wanted(batch):
        texts = batch.column(text).to_pylist()
        out = []
        for k in range(0, len(texts), 1024):
            out += [v != UNKNOWN and not (c and s < least) for v, s, c in zip(*judge(texts[k : k + 1024], model), strict=True)]
        return pa.array(out, pa.bool_())

    return keep_rows(docs, wanted)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the rows that are not held out, then predict all of them."""
    out = predict(docs, train(docs, sample_docs))
    return out.withColumn("held_out", held_out(F.col("doc_id")))
