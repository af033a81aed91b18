"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import common, exact_dedup, line_quality, mixing, packing, simhash

STAGES = [
    ("quality rules", line_quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("near dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express the fingerprints, the hash-random order and the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    older = common.scratches()  # of other queries, which may still be read
    for name, stage in STAGES:
        path = common.scratch(spark, f"stage-{name.replace(' ', '-')}")
        found = stage(spark, docs, sf_dir)
        found.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        common.release(spark, (*older, path))  # what the stage stored on its way, and the stage before
    return docs
