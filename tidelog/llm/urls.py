"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join of the possible hits.

A listed URL is a host and a path that starts with "/"; it fits that host and its subdomains where the URL's
path starts with the listed one, and the longest fitting one decides (block, where equal ones disagree). A page's
URL gives one key for each host suffix and path prefix of a size that is listed at all; each key is looked up in
the filter, and only keys that may be listed go to the join, which removes false positives.

Rules for odd input: a null URL, or one without "://", has empty host and path and fits nothing; a list row with a
null in it is ignored; repeated pages each give a row; an empty list allows everything; an empty table gives no
rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_columns, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter for each listed URL or host; it grows with the list, so it never fills up.
BITS_EACH = 16
#: Blocks of 64 bits up to which the filter is sent to every task (about 100 MB); beyond, it is merge-joined.
BROADCAST_BLOCKS = 1 << 21


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 34).bitwiseAND(blocks - 1)


def _mask(key: Column) -> Column:
    """Four of a block's 64 bits."""
    h, out = F.xxhash64(key), F.lit(0).cast("long")
    for k in range(4):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return out


def build_filter(listed: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Blocks of the filter (block, bits) over column key, and how many blocks there can be."""
    blocks = 1 << max(0, (n * BITS_EACH // 64).bit_length())
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits")), blocks


def probe(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be listed."""
    sent = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom.hint("merge")
    found = keys.withColumn("block", _block(F.col("key"), blocks)).join(sent, "block")
    return found.where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).select(*keys.columns)


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page. listed: host, path, verdict (allow or block)."""
    rules = listed.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("verdict").cast("string")).dropna()
    # A page's path is empty or starts with a slash, and its host has none: other rows never fit, and a key has one host.
    rules = rules.where("(path = '' or path like '/%') and host not like '%/%'").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = materialize(rules.select(F.concat("host", "path").alias("key"), "host", F.length("path").alias("size"), "verdict"), "url-rules")
    hosts = materialize(rules.groupBy("host").agg(F.collect_set("size").alias("sizes")), "url-hosts")
    labels = F.size(F.split("host", r"\.", -1))
    about = hosts.agg(F.count("*").alias("n"), F.collect_set(labels).alias("labels")).first()  # numbers of labels: few
    named = input_columns(pages, page_id=page_id, url=url)
    base = named.select(F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("long"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    if not about["n"]:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    base = materialize(base, "urls")
    bloom, blocks = build_filter(rules.select("key").unionByName(hosts.select(F.col("host").alias("key"))), rules.count() + about["n"])
    bloom = materialize(bloom, "url-filter")
    parts, sizes = F.split("host", r"\.", -1), F.array(*[F.lit(s) for s in sorted(about["labels"])])
    suffixes = F.transform(F.filter(sizes, lambda s: s <= F.size(parts)), lambda s: F.array_join(F.slice(parts, F.size(parts) - s + 1, s), "."))
    near = probe(base.select("row_id", "path", F.explode(suffixes).alias("key")), bloom, blocks).join(hosts, F.col("key") == hosts["host"])
    prefixes = F.transform(F.filter("sizes", lambda s: s <= F.length("path")), lambda s: F.concat("key", F.substring("path", F.lit(1), s)))
    possible = probe(near.select("row_id", F.explode(prefixes).alias("key")), bloom, blocks)
    hits = possible.join(rules.select("key", "verdict"), "key").groupBy("row_id").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), "verdict")).alias("best"))
    return base.join(hits, "row_id", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
