"""What the operators share: scratch tables in the shared folder, checked broadcasts, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that part words, for translate().
SPACES = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast only if it has been counted and its rows, by the width of their columns, have at most this many bytes.
BROADCAST_BYTES = 8_000_000


#: Paths that scratch() gave and release() hasn't deleted.
_made: list[str] = []


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(base)
        base = f"file://{base}"
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; retried tasks and later jobs see what is written there."""
    _made.append(f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def scratches() -> tuple[str, ...]:
    return tuple(_made)


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete all scratch tables of this process but some, once no DataFrame that is still to be computed reads them."""
    for path in _made:
        if path not in keep:
            drop_path(spark, path)
    _made[:] = keep


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here."""
    spark = session_of(df)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI as Hadoop writes it, for tasks."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in a broadcast table, about: Spark's width of the columns, 64 for a string or binary (digests, ids), and what holds the row."""
    return sum(64 if f.dataType.typeName() in ("string", "binary") else df.sparkSession._jvm.org.apache.spark.sql.types.DataType.fromJson(f.dataType.json()).defaultSize() for f in df.schema.fields) + 32


def size_fits(df: DataFrame) -> bool:
    """Whether a staged table has few enough rows to be broadcast."""
    most = BROADCAST_BYTES // row_bytes(df)
    return df.limit(most + 1).count() <= most


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a staged, narrow right side: broadcast if its counted rows are few, else by shuffle.

    The shuffled form leaves skewed keys of the left side to adaptive skew joins; right has unique keys.
    """
    return left.join(F.broadcast(right) if size_fits(right) else right.hint("shuffle_merge"), on, how)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ident(doc_id: Column) -> Column:
    """A whole-number id as a string that a null id has too, to join by."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("long").cast("string")), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, most_bytes: int = 128_000_000, task_bytes: int = 4_000_000) -> DataFrame:
    """df in a task a core where it is small and lies in fewer files than there are cores, as one row group is one task; others stay as they are split.

    Only the speed of work on whole texts depends on it.
    """
    n = session_of(df).sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size <= min(most_bytes, n * task_bytes) and len(df.inputFiles()) < n else df


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
