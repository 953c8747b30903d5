"""Lists, sets and hashes: single commands on a value, and ordered folds over a log of commands.

A fold gathers the commands of one key into one row, since each depends on the ones before; the log of one key
must fit a task. Where order does not matter between commands (pushes only, unions, last value of a field), the
forms below use aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import last_wins, slice_bounds


def push_left(items: Column, values: Column) -> Column:
    return F.concat(F.reverse(values), items)


def push_right(items: Column, values: Column) -> Column:
    return F.concat(items, values)


def pop_left(items: Column) -> tuple[Column, Column]:
    """The first element (null if none) and the rest."""
    return F.get(items, F.lit(0)), F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def pop_right(items: Column) -> tuple[Column, Column]:
    return F.get(items, F.size(items) - 1), F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def add_members(members: Column, values: Column) -> Column:
    return F.array_union(members, values)


def remove_members(members: Column, values: Column) -> Column:
    return F.array_except(members, values)


def set_fields(fields: Column, entries: Column) -> Column:
    """entries: array of (k, v), in order."""
    old = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return last_wins(F.concat(old, entries))


def remove_fields(fields: Column, names: Column) -> Column:
    return F.map_filter(fields, lambda k, _: ~F.array_contains(names, k))


def all_fields(fields: Column) -> Column:
    """Field, value, field, value, ... in order."""
    return F.flatten(F.transform(F.map_entries(fields), lambda e: F.array(e["key"], e["value"])))


def fold_lists(ops: DataFrame) -> DataFrame:
    """key, items after the commands (key, seq, op, arg) with op lpush, rpush, lpop or rpop, in order of seq."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "op", "arg")))

    def step(items: Column, s: Column) -> Column:
        one = F.array(s["arg"])
        return (
            F.when(s["op"] == "rpush", F.concat(items, one)).when(s["op"] == "lpush", F.concat(one, items))
            .when(s["op"] == "lpop", pop_left(items)[1]).otherwise(pop_right(items)[1])
        )

    return ops.groupBy("key").agg(steps.alias("steps")).select("key", F.aggregate("steps", F.array().cast("array<string>"), step).alias("items"))


def fold_sets(ops: DataFrame) -> DataFrame:
    """key, members: a member is in if its last command (key, seq, op, member) is sadd. One row a member and task is shuffled."""
    last = ops.groupBy("key", "member").agg(F.max_by("op", "seq").alias("op"))
    return last.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("op") == "sadd", F.col("member")))).alias("members"))


def fold_hashes(ops: DataFrame) -> DataFrame:
    """key, field, value of the last command (key, seq, op, field, value) of each field, if it is hset."""
    last = ops.groupBy("key", "field").agg(F.max_by(F.struct("op", "value"), "seq").alias("v"))
    return last.where(F.col("v.op") == "hset").select("key", "field", F.col("v.value").alias("value"))


def fold_counters(ops: DataFrame) -> DataFrame:
    """key, value after all steps (key, by)."""
    return ops.groupBy("key").agg(F.sum("by").alias("value"))


def list_range(items: Column, start: int, stop: int) -> Column:
    return slice_bounds(items, F.lit(start), F.lit(stop))
