"""The k nearest rows of a bank for each query row, exact, as products of blocks.

The queries lie in the shared folder; a task scores its rows of the bank, a block at a time, against the queries, a block at a time, and keeps k rows a
query and block, so neither side is held whole anywhere and what is shuffled is k rows a query and task. A matrix product chooses the candidates, with a margin above its
rounding; their scores are then summed in the order of the dimensions, as a query engine sums them, so values and ties don't depend on blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import shared_folder
from ..sources.storage import Store
from .vectors import doubles

#: Rows of the two sides that are scored at once.
QUERY_ROWS = 256
BANK_ROWS = 10_000

_FOUND = "query long, query_label long, item long, label long, score double"


def sided(df: DataFrame, item: str | Column, label: str | Column, vector: str) -> DataFrame:
    """(id, label, v) of the rows that have an id and a vector without nulls."""
    one = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(one(item).cast("long").alias("id"), one(label).cast("long").alias("label"), doubles(vector).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", F.isnull))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(ids, labels, vectors) for each length of vector; those with a number that isn't finite are left out."""
    lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = batch.take(pa.array(np.flatnonzero(lengths == n)))
        vectors = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
        fine = np.isfinite(vectors).all(axis=1)
        if not fine.all():
            rows, vectors = rows.filter(pa.array(fine)), vectors[fine]
        if len(rows):
            yield rows.column("id").to_numpy(), rows.column("label"), vectors


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int, distance: bool, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, bank row, score) of the k best for each query row, the best first, ties by id."""
    dim, eps = q.shape[1], np.finfo(float).eps
    product, q_square, b_square = q @ b.T, (q * q).sum(axis=1), (b * b).sum(axis=1)
    rough = 2 * product - q_square[:, None] - b_square[None, :] if distance else product
    reach = q_square + b_square.max() if distance else np.sqrt(q_square * b_square.max())
    own = np.zeros(rough.shape, bool) if itself else q_ids[:, None] == ids[None, :]
    rough[own] = -np.inf
    near = ~own
    if len(ids) > k:
        near &= rough >= (np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - 8 * (dim + 2) * eps * reach)[:, None]
    qi, bi = np.nonzero(near)
    score = np.zeros(len(qi))
    for d in range(dim):
        x, y = q[qi, d], b[bi, d]
        score += (x - y) * (x - y) if distance else x * y
    score = np.sqrt(score) if distance else score
    order = np.lexsort((ids[bi], score if distance else -score, qi))
    qi, bi, score = qi[order], bi[order], score[order]
    kept = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[kept], bi[kept], score[kept]


def nearest(queries: DataFrame, bank: DataFrame, k: int, distance: bool = False, itself: bool = True, bank_rows: int = BANK_ROWS) -> DataFrame:
    """(query, query_label, item, label, score, rank from 1) of two tables of ``sided``: by greatest dot product, or by least distance; ties by id.

    Without itself, rows of the query's own id are left out. Vectors of different lengths never meet; rows without an id or vector, or with a number
    in it that isn't finite, take no part. An empty side gives no row.
    """
    path = shared_folder(queries.sparkSession, "queries")
    queries.write.parquet(path)
    uri = Store.at(path).uri

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store.at(uri)
        files = [n for n in store.names("") if n.endswith(".parquet")]
        for batch in batches:
            for low in range(0, batch.num_rows, bank_rows):
                for ids, labels, b in _matrices(batch.slice(low, bank_rows)):
                    for name in files:
                        with store.open_input(name) as f:
                            for asked in pq.ParquetFile(f).iter_batches(QUERY_ROWS):
                                for q_ids, q_labels, q in _matrices(asked):
                                    if q.shape[1] != b.shape[1]:
                                        continue
                                    qi, bi, score = _best(q_ids, q, ids, b, k, distance, itself)
                                    columns = [pa.array(q_ids[qi]), q_labels.take(pa.array(qi)), pa.array(ids[bi]), labels.take(pa.array(bi)), pa.array(score)]
                                    yield pa.RecordBatch.from_arrays(columns, names=["query", "query_label", "item", "label", "score"])

    found = bank.mapInArrow(answer, _FOUND)
    order = W.partitionBy("query").orderBy(F.col("score").asc() if distance else F.col("score").desc(), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
