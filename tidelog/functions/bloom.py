"""Bloom filters over keys, bit for bit as the store defines them: double hashing with two FNV-1a values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two seeds, the prime, and the largest 64-bit number (sign bit off).
SEED_1, SEED_2, PRIME, MAX_LONG = 0x811C9DC5, 0x01000193, 16777619, (1 << 63) - 1


def fnv1a32(key: Column, seed: int = SEED_1) -> Column:
    data = F.encode(key, "UTF-8")
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    byte = F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))
    return F.aggregate(byte, F.lit(seed).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * PRIME).bitwiseAND(0xFFFFFFFF))


def sizes(n: int, bits_per_key: int) -> tuple[int, int]:
    """Bits and hash functions of a filter for n keys."""
    bits = max(64, n * bits_per_key)
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def bit_indexes(key: Column, bits: int, k: int) -> Column:
    h1, h2 = fnv1a32(key, SEED_1), fnv1a32(key, SEED_2)
    both = F.struct(h1.alias("a"), h2.alias("b"))
    return F.element_at(F.transform(F.array(both), lambda h: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h["a"] + i * h["b"]).bitwiseAND(MAX_LONG) % bits)), 1)


def build(keys: DataFrame, bits: int, k: int) -> DataFrame:
    """The set bits (bit) of the filter over column key."""
    return keys.select(F.explode(bit_indexes(F.col("key"), bits, k)).alias("bit")).distinct()


def probe(keys: DataFrame, filter_bits: DataFrame, bits: int, k: int) -> DataFrame:
    """key, might_contain of every distinct key."""
    wanted = keys.select("key").distinct().select("key", F.explode(F.array_distinct(bit_indexes(F.col("key"), bits, k))).alias("bit"))
    marked = wanted.join(filter_bits.withColumn("hit", F.lit(1)), "bit", "left")
    return marked.groupBy("key").agg((F.count("hit") == F.count("*")).alias("might_contain"))
