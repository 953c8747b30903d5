"""Lists, sets and hashes inside a value: a tag, then Base64 tokens joined by commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags of structured values, and the separator of a hash's field and value.
TAGS = {"list": "__sksp:list__:", "set": "__sksp:set__:", "hash": "__sksp:hash__:"}
SEPARATOR = "\u0000"


def text(value: Column) -> Column:
    return F.decode(value, "UTF-8")


def kind(value: Column) -> Column:
    """list, set, hash, string, or none where there is no value."""
    out = F.lit("string")
    for name, tag in TAGS.items():
        out = F.when(text(value).startswith(tag), name).otherwise(out)
    return F.when(value.isNull(), "none").otherwise(out)


def encode_tokens(items: Column) -> Column:
    """Spark breaks Base64 into lines; the format doesn't."""
    return F.array_join(F.transform(items, lambda x: F.regexp_replace(F.base64(F.encode(x, "UTF-8")), "[\r\n]", "")), ",")


def decode_tokens(payload: Column) -> Column:
    some = F.transform(F.split(payload, ",", -1), lambda x: F.decode(F.unbase64(x), "UTF-8"))
    return F.when(F.coalesce(payload, F.lit("")) == "", F.array().cast("array<string>")).otherwise(some)


def encode_items(items: Column, tag: str) -> Column:
    return F.encode(F.concat(F.lit(TAGS[tag]), encode_tokens(items)), "UTF-8")


def decode_items(value: Column, tag: str) -> Column:
    """The elements; empty where the value is missing, null where it has another kind."""
    held = decode_tokens(F.substring(text(value), F.lit(len(TAGS[tag]) + 1), F.length(text(value))))
    items = F.array_distinct(held) if tag == "set" else held
    return F.when(value.isNull(), F.array().cast("array<string>")).when(kind(value) == tag, items)


def encode_hash(fields: Column) -> Column:
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(SEPARATOR), e["value"]))
    return F.encode(F.concat(F.lit(TAGS["hash"]), encode_tokens(pairs)), "UTF-8")


def decode_hash(value: Column) -> Column:
    """The fields in insertion order, the last value of each; pairs without a field name are dropped."""
    pairs = F.filter(decode_tokens(F.substring(text(value), F.lit(len(TAGS["hash"]) + 1), F.length(text(value)))), lambda p: F.locate(SEPARATOR, p) > 1)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, SEPARATOR, 1).alias("k"), F.substring(p, F.locate(SEPARATOR, p) + 1, F.length(p)).alias("v")))
    return F.when(value.isNull(), F.create_map().cast("map<string,string>")).when(kind(value) == "hash", last_wins(entries))


def last_wins(entries: Column) -> Column:
    """A map of entries (k, v): fields in order of first appearance, with their last value."""
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), -1)["v"]))


def slice_bounds(items: Column, start: Column, stop: Column) -> Column:
    """Both ends included; negative ones count from the end; out of range is clamped."""
    size = F.size(items)
    first = F.greatest(F.when(start >= 0, start).otherwise(size + start), F.lit(0))
    last = F.least(F.when(stop >= 0, stop).otherwise(size + stop), size - 1)
    length = F.greatest(F.when((last < 0) | (first >= size), F.lit(0)).otherwise(last - first + 1), F.lit(0))
    return F.slice(items, F.least(first, F.greatest(size - 1, F.lit(0))) + 1, length)
