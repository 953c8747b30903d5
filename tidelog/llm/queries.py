"""The registered queries of the ten operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import table
from .secrets import BASE, RULES

#: The URL list of op10: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: The key of op6's surrogates; a deployment passes its own.
PII_KEY = "tidelog-example-key"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest, find_hits

    return digest(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import cluster

    return cluster(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: labelled as of quality and not toxic. The threshold is fitted on these and the texts labelled as without quality."""
    from .quality import judge

    labels = table(spark, sf_dir, "labels")
    judged = labels.where("quality = 0 or toxic = 0").selectExpr("doc_id", "quality = 1 as good")
    return judge(table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"), judged)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents"), path="doc_id", content="text"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace

    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages"))


def op8_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import round_trip

    return round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_file())


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_ngram_jaccard_join, op4_quality_rules, op5_secret_scan, op6_pii_surrogates, op7_warc_round_trip, op8_rans_token_files, op9_best_fit_packing, op10_url_filter)}
ORACLE_SQL = {
    "op2_decontaminate": sql.DECONTAMINATE,
    "op3_ngram_jaccard_join": sql.JACCARD,
    "op5_secret_scan": sql.secrets(RULES, tuple(r.kind for r in BASE)),
    "op7_warc_round_trip": sql.WARC,
    "op10_url_filter": sql.urls(URL_RULES),
}
