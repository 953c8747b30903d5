"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio of trusted to raw text.

Word unigrams and bigrams fall by hash into BUCKETS; two multinomials over the buckets are counted, over the
trusted texts and over all texts. A text's score is the sum over its n-grams of the log ratio of the two,
divided by their number. Ratios are whole numbers of 2^-SHIFT, so sums don't depend on their order and the same
text always meets the threshold alike.

The threshold is fitted in the run, on texts that are judged good or bad and pass the base rules: it is the cut that
tells most of them apart, halfway to the next score below. Trusted texts score higher for being in the multinomial,
so a quarter of those that are judged, by hash of the id, are left out of it, and only these count as good ones in
the fit. Bad ones are never trusted. Without both kinds, the threshold is THRESHOLD.

Everything is a JVM expression. Texts are never shuffled: each n-gram's ratio is looked up in a broadcast table of
BUCKETS rows, and a text's sum is complete in its task but for one row a text.

Rules for odd input: null text is an empty one (no words: all counts 0, base_failed); a very long text is split in one
task's memory; a null doc_id stays null; repeated rows each give a row and each count in the raw multinomial; trusted
or judged rows without a doc_id are ignored, and repeated ones count once (good, if they disagree); without trusted
texts every score is 0, which meets a threshold of 0 or less; scores at the threshold are kept; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import input_columns, materialize, scratch
from .expressions import at, following, let, numbers, words

BUCKETS = 1 << 18
SHIFT = 16
#: Steps of the threshold in one log unit.
STEPS = 1 << 10
#: Least score, in log units per n-gram, that the method keeps where none can be fitted.
THRESHOLD = -0.25
#: Repeated 3-word windows of a text up to which membership is looked up one by one.
FEW = 16
#: Trusted ids up to which they are sent to every task (16 bytes each); beyond, the join is a shuffle.
BROADCAST_IDS = 200_000
MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bucket(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def exploded(docs: DataFrame, *columns: str) -> DataFrame:
    """A row for each word of column w: the columns, u (its bucket) and v (that of it and the next word, null for the last).

    A text without words has one row of nulls.
    """
    pairs = F.arrays_zip(F.col("w").alias("a"), following(F.col("w"), 1).alias("b"))
    each = docs.select(*columns, F.explode_outer(pairs).alias("p"))
    return each.select(*columns, F.when(F.col("p.a").isNotNull(), _bucket(F.col("p.a"))).alias("u"), F.when(F.col("p.b").isNotNull(), _bucket(F.col("p.a"), F.col("p.b"))).alias("v"))


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def looked_up(hashes: Column, repeated: Column) -> Column:
        return covered(F.filter(numbers(0, F.size(hashes) - 1), lambda i: F.array_contains(repeated, at(hashes, i))))

    def sorted_out(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, j, k: F.coalesce(at(s, j)["h"] == at(s, k)["h"], F.lit(False))
        return covered(let(placed, lambda s: F.transform(F.filter(numbers(0, F.size(s) - 1), lambda k: same(s, k, k - 1) | same(s, k, k + 1)), lambda k: at(s, k)["i"])))

    def some(hashes: Column) -> Column:
        ordered = F.sort_array(hashes)
        repeated = let(ordered, lambda s: F.array_distinct(F.filter(s, lambda h, i: (i > 0) & (h == F.coalesce(at(s, i - 1), h + 1)))))
        return let(repeated, lambda r: F.when(F.size(r) <= FEW, looked_up(hashes, r)).otherwise(sorted_out(hashes)))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(some(hashes))

    windows = F.arrays_zip(w.alias("a"), following(w, 1).alias("b"), following(w, 2).alias("c"))  # the last two are short
    return let(F.transform(F.slice(windows, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x: F.xxhash64(x)), counted)


def base(docs: DataFrame) -> DataFrame:
    """The counts of every text; keeps its words for later steps."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumn("w", words(text)).select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return input_columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def set_aside(doc_id: Column) -> Column:
    """The quarter of judged texts that the multinomial leaves out."""
    return F.crc32(doc_id.cast("string")) % 4 == 1


def ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, ratio: the log ratio of each bucket that occurs, in units of 2^-SHIFT. trusted: doc_id of texts of the target."""
    ids = materialize(trusted.select("doc_id").distinct().withColumn("is_target", F.lit(1)), "trusted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    marked = _named(docs, doc_id, text).join(ids, "doc_id", "left").select(words(F.col("text")).alias("w"), F.coalesce("is_target", F.lit(0)).alias("is_target"))
    grams = exploded(marked, "is_target").select("is_target", F.explode(F.array("u", "v")).alias("bucket")).where("bucket is not null")
    counts = materialize(grams.groupBy("bucket").agg(F.count("*").alias("c"), F.sum("is_target").alias("t")), "counts")  # at most BUCKETS rows
    sums = counts.agg((F.sum("c") + BUCKETS).alias("n"), F.sum("t").alias("m"))
    share = (F.col("c") + 1) / F.col("n")
    ratio = F.log((F.col("t") + BUCKETS * share) / (F.col("m") + BUCKETS) / share)
    return materialize(counts.join(F.broadcast(sums)).select("bucket", F.round(ratio * (1 << SHIFT)).cast("long").alias("ratio")), "ratios")  # one row is sent


def scores(docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """COUNTS and total (the sum of its n-grams' ratios) of every text."""
    counted = base(_named(docs, doc_id, text)).withColumn("row_id", F.monotonically_increasing_id())
    each = exploded(counted, "row_id", *COUNTS)
    for gram in "uv":
        each = each.join(F.broadcast(weights.select(F.col("bucket").alias(gram), F.col("ratio").alias(f"{gram}_ratio"))), gram, "left")
    total = F.coalesce("u_ratio", F.lit(0)) + F.coalesce("v_ratio", F.lit(0))
    return each.groupBy("row_id", *COUNTS).agg(F.sum(total).alias("total")).drop("row_id")


def fit(scored: DataFrame, judged: DataFrame) -> int | None:
    """The least score to keep, in steps, that tells judged texts (doc_id, good) apart best; None without both kinds."""
    step = F.floor(F.col("total") * STEPS / ((2 * F.col("n_words") - 1) * (1 << SHIFT))).cast("long")
    known = scored.where(~_failed()).join(judged, "doc_id").where(~F.col("good") | set_aside(F.col("doc_id")))
    cells = known.groupBy(step.alias("step")).agg(F.count(F.when(F.col("good"), 1)).alias("g"), F.count(F.when(~F.col("good"), 1)).alias("b"))
    up, every = Window.orderBy("step"), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each step that occurs
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    exact = lambda c: c.cast("decimal(19,0)")
    gain = exact(F.coalesce(F.sum("b").over(below), F.lit(0))) * exact(F.sum("g").over(every)) - exact(F.coalesce(F.sum("g").over(below), F.lit(0))) * exact(F.sum("b").over(every))
    cuts = cells.select("step", F.lag("step").over(up).alias("last"), gain.alias("gain"), F.sum("g").over(every).alias("all_g"), F.sum("b").over(every).alias("all_b")).where("all_g > 0 and all_b > 0")
    best = cuts.orderBy(F.col("gain").desc(), "step").limit(1).select(F.floor((F.coalesce(F.col("last") + 1, "step") + F.col("step")) / 2).alias("cut")).collect()
    return best[0]["cut"] if best else None


def judge(docs: DataFrame, trusted: DataFrame, judged: DataFrame | None = None, threshold: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts, base_failed, score and kept of every text.

    trusted: doc_id of texts of the target. judged: doc_id, good of texts that the threshold is fitted on, unless it is given.
    """
    ids = input_columns(trusted, doc_id="doc_id").select(F.col("doc_id").cast("long")).dropna()
    with scratch(docs.sparkSession):
        known = None
        if judged is not None and threshold is None:
            known = input_columns(judged, doc_id="doc_id", good="good").select(F.col("doc_id").cast("long"), F.col("good").cast("boolean")).dropna()
            known = materialize(known.groupBy("doc_id").agg(F.bool_or("good").alias("good")), "judged")
            ids = ids.join(known.where(set_aside(F.col("doc_id"))), "doc_id", "left_anti")
        scored = materialize(scores(docs, ratios(docs, ids, doc_id, text), doc_id, text), "scored", keep=True)
        cut = fit(scored, known) if known is not None else None
    if cut is None:
        cut = round((THRESHOLD if threshold is None else threshold) * STEPS)
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    enough = F.col("total") * STEPS >= F.lit(cut * (1 << SHIFT)) * grams
    return scored.select(
        *COUNTS,
        _failed().alias("base_failed"),
        (~_failed() & enough).alias("kept"),
        F.when(grams > 0, F.col("total") / (grams * (1 << SHIFT))).otherwise(0.0).alias("score"),
    )
