"""Blocks: one Parquet file for each block id, written and verified by tasks, read as one DataFrame."""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import block_locator, check_block_id, check_locator
from .storage import Store

REFS = "block_id string, locator string, num_rows long"


def write_table(store: Store, block_id: str, table: pa.Table) -> tuple[str, str, int]:
    """Write one block; its block_id column is added, or must be constant."""
    check_block_id(block_id)
    if "block_id" in table.column_names:
        if set(table.column("block_id").to_pylist()) - {block_id}:
            raise ValueError(f"rows of block {block_id!r} name another block")
    else:
        table = table.append_column("block_id", pa.array([block_id] * table.num_rows, pa.string()))
    out = io.BytesIO()
    pq.write_table(table, out)
    store.write(block_locator(block_id), out.getvalue())
    return block_id, block_locator(block_id), table.num_rows


def write_blocks(rows: DataFrame, store: Store) -> DataFrame:
    """Write the blocks that the block_id column of rows names, one a group; the references (small) are the result.

    Lazy: the files exist once the result has been computed. Retried tasks overwrite a block with the same bytes.
    """

    def one(key: tuple, table: pa.Table) -> pa.Table:
        block_id, locator, n = write_table(store, key[0].as_py(), table)
        return pa.table({"block_id": [block_id], "locator": [locator], "num_rows": pa.array([n], pa.int64())})

    return rows.groupBy("block_id").applyInArrow(one, REFS)


def read_block(spark: SparkSession, store: Store, locator: str) -> DataFrame:
    return spark.read.parquet(store.path(check_locator(locator)))


def load_block(store: Store, locator: str) -> pa.Table:
    """One block as an Arrow table, for tasks."""
    with store.open_input(check_locator(locator)) as file:
        return pq.read_table(file)


#: Up to so many files are named to the reader one by one; for more the folder is read, and the join drops other blocks.
MOST_NAMED = 100_000


def read_blocks(spark: SparkSession, store: Store, manifest: DataFrame, schema=None, row: str | None = None) -> DataFrame:
    """The rows of the manifest's blocks with seq, pos and position. Files are read once; a block that stands twice gives its rows twice.

    Only files that the manifest names are opened. The manifest is a row a block and is joined to the rows by block_id; Spark broadcasts it
    while it is small. row: a column for a row's number in its file.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    places = manifest.select("seq", "pos", "position", "block_id")
    files = [store.path(check_locator(r[0])) for r in manifest.select("locator").distinct().limit(MOST_NAMED + 1).collect()]
    found = reader.parquet(*sorted(files)) if 0 < len(files) <= MOST_NAMED else reader.parquet(store.path("blocks"))
    if row is not None:
        found = found.select("*", F.col("_metadata.row_index").alias(row))
    return found.join(places, "block_id")


def footers(refs: DataFrame, store: Store) -> DataFrame:
    """Rows by the footer of each file, without reading data: (block_id, num_rows, found, problem)."""

    def count(batches):
        for batch in batches:
            found, problems = [], []
            for locator in batch.column("locator").to_pylist():
                try:
                    with store.open_input(check_locator(locator)) as f:
                        found.append(pq.read_metadata(f).num_rows)
                    problems.append(None)
                except Exception as e:  # what is wrong with a file is the answer here
                    found.append(None)
                    problems.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays(
                [batch.column("block_id"), batch.column("num_rows"), pa.array(found, pa.int64()), pa.array(problems, pa.string())], names=["block_id", "num_rows", "found", "problem"]
            )

    return refs.select("block_id", "locator", "num_rows").mapInArrow(count, "block_id string, num_rows long, found long, problem string")


def verify_blocks(refs: DataFrame, store: Store) -> list[str]:
    """The first five ids of blocks that are missing, unreadable or of another size; raises if there are any."""
    bad = footers(refs, store).where("found is null or found <> num_rows").select("block_id").orderBy("block_id").limit(6).collect()
    if bad:
        names = [r[0] for r in bad]
        raise FileNotFoundError(f"block files missing or corrupt: {names[:5]}{' ...' if len(names) > 5 else ''}")
    return []


def constant_problems(rows: DataFrame) -> DataFrame:
    """Files whose rows don't all name the block that the file is called after."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet$", 1)
    return rows.withColumn("file", name).groupBy("file").agg(F.count_if(~F.col("block_id").eqNullSafe(F.col("file"))).alias("wrong")).where("wrong > 0")
