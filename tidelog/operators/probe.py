"""k-nearest-neighbour votes: queries against a bank, similarity-weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.nearest import BANK_ROWS, nearest, sided


def neighbours(queries: DataFrame, bank: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding", label: str = "label", bank_rows: int = BANK_ROWS, itself: bool = True) -> DataFrame:
    """(query, query_label, item, label, sim, rank): the k nearest of the bank by dot product, ties by id; without itself, rows of the query's own id are left out.

    Each pair is scored once, as the definition asks, bank_rows of the bank at a time.
    """
    found = nearest(sided(queries, item, label, vector), sided(bank, item, label, vector), k, itself=itself, bank_rows=bank_rows)
    return found.withColumnRenamed("score", "sim")


def vote(found: DataFrame, temperature: float) -> DataFrame:
    """(query, query_label, predicted): the label with the greatest sum of exp(sim / temperature), ties to the least label."""
    sums = found.groupBy("query", "query_label", "label").agg(F.sum(F.exp(F.col("sim") / temperature)).alias("weight"))
    order = W.partitionBy("query").orderBy(F.col("weight").desc(), "label")
    return sums.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query", "query_label", F.col("label").alias("predicted"))


def accuracy(queries: DataFrame, bank: DataFrame, k: int, temperature: float, classes: int, **names) -> DataFrame:
    """One row: queries and the share that the vote gets right."""
    if bank.isEmpty():
        raise ValueError("the bank is empty")
    label = names.get("label", "label")
    if not bank.where((F.col(label) < 0) | (F.col(label) >= classes)).isEmpty():
        raise ValueError(f"a label is outside 0 to {classes - 1}")
    votes = vote(neighbours(queries, bank, k, **names), temperature)
    return votes.agg(F.count("*").alias("queries"), F.avg((F.col("query_label") == F.col("predicted")).cast("double")).alias("accuracy"))


PROBE_FILE = "probe/test.parquet"


def write_probe_split(rows: DataFrame, store) -> str:
    """The held-out rows of a store, one file of bounded size by definition; its name."""
    import io

    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(rows.toArrow(), out)
    store.write(PROBE_FILE, out.getvalue())
    return PROBE_FILE


def read_probe_split(spark, store, limit: int | None = None) -> DataFrame:
    """The held-out rows, or the first ones of their file."""
    if not store.exists(PROBE_FILE):
        raise FileNotFoundError(f"no probe split at {store.uri}")
    rows = spark.read.parquet(store.path(PROBE_FILE))
    if limit is None:
        return rows
    return rows.select("*", F.col("_metadata.row_index").alias("_row")).orderBy("_row").limit(limit).drop("_row")


def run_probe(spark, log, k: int = 20, temperature: float = 0.1, classes: int = 10, train_rows: int | None = 5000, test_rows: int | None = 2000, embed=None, **names) -> DataFrame:
    """One row: queries, accuracy, chance, bank. The bank is the log's first rows, the queries are the store's held-out ones; embed maps either to vectors."""
    embed = embed or (lambda df: df)
    bank, held = embed(log.rows(spark, train_rows)), embed(read_probe_split(spark, log.store, test_rows))
    if bank.isEmpty():
        raise ValueError("the log has no rows for a bank")
    found = accuracy(held, bank, k, temperature, classes, **names)
    return found.withColumn("chance", F.lit(1.0 / classes)).withColumn("bank", F.lit(bank.count()))
