"""The version log: one row per version of a key."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, DELETE, NEVER = 1, 2, -1

LOG = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("vtype", T.ByteType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("expire_at_ms", T.LongType(), False),
])
COLUMNS = LOG.fieldNames()
