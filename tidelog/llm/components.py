"""Connected components of a links table, by alternating star contractions.

Links of a node never meet in one task: each half-round takes a minimum per node (folded before the
shuffle) and joins it back. Nodes of very many links are few, so their minima are broadcast and their links stay where they are;
the others are joined by shuffle and have at most ``HUB`` links each. The rounds go on until nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch, size_fits

LINKS = "a long, b long"
#: A node of more links than this is a hub; of n links there are at most n / HUB.
HUB = 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a-b, a star forest with the same components: (node, least node of its component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _local(batches):
    """A task's links, contracted to stars whenever a bounded number has gathered."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column("a").to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column("b").to_numpy(zero_copy_only=False)])
        if len(a) > 2_000_000:
            a, b = forest(a, b)
            if len(a) > 1_000_000:  # contracted as far as this task can: pass it on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def joined(rows: DataFrame, per: DataFrame, key: str) -> DataFrame:
    """rows with the columns of per (key, n rows of that key, ...), which is staged and has each key once."""
    if size_fits(per):
        return rows.join(F.broadcast(per.drop("n")), key)
    hubs, others = per.where(F.col("n") > HUB).drop("n"), per.where(F.col("n") <= HUB).drop("n")
    if hubs.isEmpty() or not size_fits(hubs):  # beyond that, skewed keys are left to adaptive joins
        return rows.join(per.drop("n"), key)
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key)
    return rows.join(F.broadcast(hubs), key).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node with a link to another: root is the least node reachable."""
    spark = links.sparkSession

    def keep(df: DataFrame, schema: str) -> tuple[DataFrame, str]:
        path = scratch(spark, "links")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    stars, path = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_local, LINKS).distinct(), LINKS)
    per = "a long, m long, n long"
    while True:
        # large star: every greater neighbour of a node, linked to the node's least neighbour
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), per)
        large, large_path = keep(joined(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), LINKS)
        # small star: every smaller neighbour, and the node, linked to the least of them
        low, low_path = keep(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), per)
        small = joined(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new, new_path = keep(small.where("a <> b").distinct(), LINKS)
        # settled when every node has one link and no root is a node with a link
        settled = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        for done in (path, least_path, large_path, low_path):
            drop_path(spark, done)
        stars, path = new, new_path
        if settled:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
