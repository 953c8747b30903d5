"""Small tables for the edge cases that every operator shares."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and blank texts, one word, odd characters, a long text, copies and repeated rows.
EDGES = [
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "word", "en", "s", 4),
    (5, "ÀÉ ñandú ΑΣ 中文 \U0001F600 don't stop", "es", "s", 30),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s", 66),
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s", 66),
    (8, "Alpha  BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "en", "s", 70),
    (9, "x " * 30000 + "the end", "en", "s", 60007),
    (10, "one two three four", "en", "s", 18),
    (11, "one two three four five", "en", "s", 23),
    (11, "one two three four five", "en", "s", 23),
    (None, "one two three four five", "en", "s", 23),
    (None, None, None, None, None),
]


def edge_docs(spark):
    return spark.createDataFrame(EDGES, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["row_id", "w", "blob", "path", "set_id", "bucket", "digest", "size", "key", "block", "shard", "words", "content", "ids", "held_out", "part", "pos", "join_row", "pii_row", "pii_map", "counts", "shingle", "root", "rule", "verdict", "u", "v", "score"]
    return df.select("*", *[F.lit("clash").alias(n) for n in names if n not in df.columns])


def space_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
