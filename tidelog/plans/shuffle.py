"""Bit-exact shuffles: CPython's Mersenne Twister seeded by an integer pair, for logs that other programs also write.

Relational plans use the digest order of ``functions.numbering``; exact order is needed only where the order inside
a committed segment, or of a pass, has to be the same as an existing writer's.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame


def exact_order(items: list, seed: int, number: int) -> list:
    out = list(items)
    random.Random(hash((seed, number))).shuffle(out)
    return out


def exact_segments(chunks: DataFrame, seed: int) -> DataFrame:
    """(seq, slot, block_id) -> (seq, pos, block_id): one segment a group, W rows each."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        order = exact_order(rows["block_id"].tolist(), seed, int(rows["seq"].iloc[0]))
        return pd.DataFrame({"seq": rows["seq"].iloc[0], "pos": range(len(order)), "block_id": order})

    return chunks.select("seq", "slot", "block_id").groupBy("seq").applyInPandas(one, "seq long, pos long, block_id string")


def exact_passes(blocks: DataFrame, seed: int, passes: int) -> DataFrame:
    """(block_id) -> (pass, i, block_id). A pass's permutation is one serial draw, so each pass is one group of ids."""
    from pyspark.sql import functions as F

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["pass"].iloc[0])
        order = exact_order(sorted(rows["block_id"]), seed, number)
        return pd.DataFrame({"pass": number, "i": range(len(order)), "block_id": order})

    every = blocks.select("block_id").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long"))))
    return every.groupBy("pass").applyInPandas(one, "pass long, i long, block_id string")
