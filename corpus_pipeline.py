"""A corpus pipeline of five operators: language ID, near-duplicate removal, decontamination, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a table that is
written as Parquet and read again for the next. All but the last return the columns of documents. Rules for odd
input are those of the operators: a null or wordless text has no language and goes at the first stage; repeated
rows are near-duplicates; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, language, ngram_join, packing, pii
from tidelog.llm.common import fresh_path, remove, scratch, table
from tidelog.llm.queries import PII_KEY, tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language.accept(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced; n_chars follows the new text."""
    out = pii.replace(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token sequences in windows."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", pack),
]

#: Token ids, keyed hashes and components over all documents are beyond SQL here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. A stage's tables on the way, and its predecessor's result, are removed when it is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        remove(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), [path]
    return docs
