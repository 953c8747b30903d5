"""Secret scans with an incremental blob ledger.

Every historical version of every path is content-addressed by SHA-256. Only blobs and rule versions that the
ledger has not seen together are scanned, each blob once however many paths hold it; the ledger gains one row a
blob and run; findings are joined back to all paths. Spans are code points, end exclusive; a rule's matches are
leftmost and don't overlap, and one whose secret is too short is dropped with what it covers.

Rules for odd input: null content is an empty blob; very long texts are scanned whole, in one task's memory; findings
at one place go by the rules' order; repeated rows and null paths each give a row; an empty table gives no rows;
columns other than the named ones are ignored, whatever their names; a new version of a rule is scanned for as a new
rule; a blob that two scans met at once is in the ledger twice, and its findings count once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, input_columns
from .expressions import let, matches, numbers


#: Matches of a text that are placed together: a text with very many of them takes time in proportion to their number.
STEPS = 512


class Rule(NamedTuple):
    """pattern's group must have at least so many characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 30),
)

FINDING = "array<struct<start:int,rank:int,end:int,kind:string,rule:string>>"
LEDGER = f"blob string, seen array<string>, findings {FINDING}"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """A rule's findings in a text, from the lengths of its matches and of what lies between them."""
    none = F.array().cast(FINDING)

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        finding = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + s["size"]).alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"))
        return F.when(s["size"].isNull(), acc).otherwise(F.struct((start + s["size"]).alias("at"), F.when(s["secret"] >= rule.least, F.concat(acc["out"], F.array(finding))).otherwise(acc["out"]).alias("out")))

    def placed(found: Column) -> Column:
        steps = F.zip_with(found["between"], found["whole"], lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
        steps = F.zip_with(steps, found["secret"], lambda s, x: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(x).alias("secret")))
        chunks = let(steps, lambda t: F.transform(numbers(0, F.ceil(F.size(t) / STEPS).cast("int") - 1), lambda k: F.slice(t, k * STEPS + 1, F.lit(STEPS))))
        return let(chunks, whole)

    def whole(chunks: Column) -> Column:
        zero = F.lit(0)
        sizes = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, s: a + s["gap"] + F.coalesce(s["size"], zero)))
        first = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(sizes, first, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, begins, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    found = F.struct(F.split(text, rule.pattern, -1).alias("between"), matches(text, rule.pattern).alias("whole"), matches(text, rule.pattern, rule.group).alias("secret"))
    return F.when(text.rlike(rule.pattern), let(found, placed)).otherwise(none)


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """path, blob, findings of every version; extends the ledger (a Parquet folder; a fresh one if None)."""
    spark = versions.sparkSession
    named = input_columns(versions, path=path, content=content).withColumn("content", F.coalesce(F.col("content").cast("string"), F.lit("")))
    named = named.withColumn("blob", F.sha2(F.col("content").cast("binary"), 256))
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = named.groupBy("blob").agg(F.first("content").alias("content"))  # a copy per blob and task is all that is shuffled
    if ledger is None:
        ledger = fresh_path(spark, "ledger")
        todo = blobs.withColumn("new", keys)
    else:
        known = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
        todo = blobs.join(known, "blob", "left").withColumn("new", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("new") > 0)
    found = [F.when(F.array_contains("new", r.key), spans(F.col("content"), r, i)).otherwise(F.array().cast(FINDING)) for i, r in enumerate(rules)]
    todo.select("blob", F.col("new").alias("seen"), F.concat(*found).alias("findings")).write.mode("append").parquet(ledger)
    current = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.filter("findings", lambda f: F.array_contains(keys, f["rule"])).alias("findings")).where(F.size("findings") > 0)
    current = current.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    return named.select("path", "blob").join(current, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def create_ledger(spark, path: str) -> str:
    """An empty ledger, to be extended by scans."""
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def _is(kind: str):
    return lambda f: f["kind"] == kind


def digest(found: DataFrame, base_kinds: tuple[str, ...] = tuple(r.kind for r in BASE)) -> DataFrame:
    """doc_id, the base kinds' counts, base_sha256 and spans."""

    def text(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = F.filter("findings", lambda f: f["kind"].isin(*base_kinds))
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(F.filter("findings", _is(k))).cast("long").alias(f"n_{k}") for k in base_kinds],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("findings")).alias("spans"),
    )
