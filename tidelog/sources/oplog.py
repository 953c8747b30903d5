"""Version logs and command logs derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETE, NEVER, PUT

#: The fixed clock of the registered queries, and how long a put with expiry lives.
NOW_MS = 1706659200000
TTL_MS = 21600000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, cut not rounded, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return days * 86400000 + seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user's key: errors delete, signups expire."""
    e = table(spark, sf_dir, "events")
    is_error = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(is_error, DELETE).otherwise(PUT).cast("tinyint").alias("vtype"),
        F.when(~is_error, F.encode("props", "UTF-8")).alias("value"),
        F.when(F.col("event_type") == "signup", epoch_ms(F.col("ts")) + TTL_MS).otherwise(F.lit(NEVER).cast("long")).alias("expire_at_ms"),
    )


def with_files(log: DataFrame, rows: int = 1000) -> DataFrame:
    """The log as flushed every so many versions: level 0, file by sequence number."""
    return log.withColumn("level", F.lit(0)).withColumn("file_id", F.expr(f"(seq - 1) div {rows} + 1"))


def conversation_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("key"), F.col("turn").alias("seq"), F.lit("rpush").alias("op"), F.concat_ws("/", "role", F.col("turn").cast("string")).alias("arg"))


def event_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event adds its type to its user's set; each error removes the type click."""
    e = table(spark, sf_dir, "events")
    is_error = F.col("event_type") == "error"
    return e.select(F.concat(F.lit("types:"), F.col("user_id").cast("string")).alias("key"), "event_id", F.col("event_id").alias("seq"), F.when(is_error, "srem").otherwise("sadd").alias("op"), F.when(is_error, "click").otherwise(F.col("event_type")).alias("member"))


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event sets the field of its type to its properties; each error deletes the field view."""
    e = table(spark, sf_dir, "events")
    is_error = F.col("event_type") == "error"
    return e.select(F.concat(F.lit("last:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.when(is_error, "hdel").otherwise("hset").alias("op"), F.when(is_error, "view").otherwise(F.col("event_type")).alias("field"), "props")
