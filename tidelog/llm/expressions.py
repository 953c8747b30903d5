"""Column expressions shared by the operators that stay on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def following(items: Column, n: int) -> Column:
    """The items from number n on."""
    return F.slice(items, F.lit(n + 1), F.greatest(F.size(items) - n, F.lit(0)))


def numbers(first: int, last: Column) -> Column:
    """first..last as an array; empty if last is less."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def at(items: Column, i: Column) -> Column:
    """Item number i from 0."""
    return F.get(items, i)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
