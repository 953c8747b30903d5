"""Numbers held as text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_long(text: Column) -> Column:
    """A 64-bit whole number with an optional sign and nothing else; null if the text is no such number."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def step(text: Column, by: int) -> Column:
    """The number after adding by; a missing text counts as 0, a bad or overflowing one gives null."""
    return F.try_add(parse_long(F.coalesce(text, F.lit("0"))), F.lit(by).cast("bigint"))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b <= 0, F.lit(0.0)).otherwise(a / b)


def bloom_bits_per_key(false_positives: float) -> int:
    p = false_positives if 0 < false_positives < 1 else 0.01
    return max(1, math.ceil(-math.log(p) / math.log(2) ** 2))
