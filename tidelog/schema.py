"""Schemas of log documents, audit records and ledgers."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

BLOCK_REF = T.StructType([
    T.StructField("block_id", T.StringType(), False),
    T.StructField("locator", T.StringType(), False),
    T.StructField("num_rows", T.LongType(), False),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType()), True),
])
SEGMENT = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("W", T.LongType(), False),
    T.StructField("seed", T.LongType(), False),
    T.StructField("pass", T.LongType(), False),
    T.StructField("schema_version", T.LongType(), False),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("blocks", T.ArrayType(BLOCK_REF), False),
])
MANIFEST = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("pass", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("position", T.LongType()),
    T.StructField("block_id", T.StringType()), T.StructField("locator", T.StringType()), T.StructField("num_rows", T.LongType()),
])
AUDIT = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("attempt", "rank", "world_size", "segment", "step", "position")],
    T.StructField("block_id", T.StringType()), T.StructField("ts", T.DoubleType()),
])
LEDGER = T.StructType([T.StructField(c, T.LongType()) for c in ("segment", "cursor", "world_size", "pass_idx", "run_attempt")])
