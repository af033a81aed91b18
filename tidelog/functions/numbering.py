"""Row numbers in a hash order without one task for all rows.

The order key is a hexadecimal digest, so its leading digits cut the rows in ranges of like size: rows are
numbered within a range, ranges are counted, and a running sum over at most 16^DIGITS counts places each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DIGITS = 3


def digest_key(*parts) -> Column:
    """md5 of the parts joined by colons: an order that any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def digest_rank(df: DataFrame, within: list[str], key: Column, ties: list[str], name: str) -> DataFrame:
    """df with the row's number, from 0, in the order of key and ties among the rows that agree in ``within``."""
    df = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, DIGITS))
    counts = df.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*within, "_range").orderBy("_key", *ties)
    out = df.join(starts, [*within, "_range"]).withColumn(name, (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
    return out.drop("_key", "_range", "_start")


def digest_ring(df: DataFrame, within: list[str], item: str, key: Column) -> DataFrame:
    """df with ``at``, ``size`` and ``next``: the item's place in the order of key among the rows that agree in ``within``, their number, and the item that
    follows, the last one's being the first. Rows are numbered as in digest_rank; the last of a range is followed by the next range's first."""
    df = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, DIGITS))
    ranges = df.groupBy(*within, "_range").agg(F.count("*").alias("_n"), F.min(F.struct("_key", item)).alias("_head"))
    order = W.partitionBy(*within).orderBy("_range")
    placed = ranges.select(
        *within, "_range", (F.sum("_n").over(order) - F.col("_n")).alias("_start"), F.sum("_n").over(W.partitionBy(*within)).alias("size"),
        F.coalesce(F.lead("_head").over(order), F.first("_head").over(order))[item].alias("_following"),
    )
    inside = W.partitionBy(*within, "_range").orderBy("_key", item)
    out = df.join(placed, [*within, "_range"]).withColumn("at", (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
    return out.withColumn("next", F.coalesce(F.lead(item).over(inside), F.col("_following"))).drop("_key", "_range", "_start", "_following")
