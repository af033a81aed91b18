"""Exact deduplication by an extendible-hash index on shared files.

A row's text, without ASCII white space, is hashed to a 64-bit key. The index directory maps the key's
leading bits to buckets: it starts with one bucket and doubles while a bucket holds more keys or bytes than
its capacity, up to all bits of the key (a bucket of one key can't be split and chains instead). Each
bucket has one owner task, which reads its page, follows the chain of equal keys and compares bytes.

Copies of one text never meet in one task: they are folded to one entry (best row, count) by the tasks that read
them, and folded again by text and salt, so that an owner gets at most ``SALTS`` entries of a text, fewer of a long one,
whatever the number of map tasks; a bucket's bytes are counted with that. Rows get their group back by
a join on key and digest, whose skewed keys Spark splits. Texts travel only for keys that more than one row has. Directory
and pages are Parquet in the shared folder.

Defined cases: null counts as the empty text, and all texts without a visible character are equal; rows
that repeat are copies of each other; a null id sorts after all others; of rows with the same text, length and
id just one stays, any; an empty table gives an empty result; extra columns are ignored by ``groups`` and kept by ``stage``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, ident, join_checked, scratch, spread, staged, text_of

#: Keys, and bytes of entries, that a bucket holds before it splits.
CAPACITY = 2_000
PAGE_BYTES = 16_000_000
#: Bits of the first directory; buckets that are overfull there double on their own, up to all 64.
FIRST_BITS = 16
#: Entries of one text that its owner gets at most, and the bytes they may have together.
SALTS = 64
SALTED_BYTES = 16_000_000

PAGE = "bucket long, key long, sha binary, body string, n_cp long, low_id long, n long"
CELLS = "cell long, base long, extra int"


def normal(column: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(column, SPACES, "")


def salts(n_bytes: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(SALTS), F.floor(F.lit(SALTED_BYTES) / (n_bytes + 1)))).cast("long")


def directory(counts: dict[int, tuple[int, int]], capacity: int = CAPACITY, page_bytes: int = PAGE_BYTES, bits: int = FIRST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, overfull) of each cell of a directory of that many bits, from the keys and bytes in each cell.

    Cells of one bucket are neighbours, so owners hold ranges of the key space. A bucket is as many cells as it may hold; overfull
    are single cells that hold too much.
    """
    keys, size = np.zeros((1 << bits) + 1, np.int64), np.zeros((1 << bits) + 1, np.int64)
    for cell, (n, n_bytes) in counts.items():
        keys[cell + 1], size[cell + 1] = n, n_bytes
    keys, size = np.cumsum(keys), np.cumsum(size)
    bucket, overfull = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
    todo, number = [(0, 0)], 0  # (local depth, prefix), lowest prefix last
    while todo:
        depth, prefix = todo.pop()
        low, high = prefix << (bits - depth), (prefix + 1) << (bits - depth)
        full = keys[high] - keys[low] > capacity or (size[high] - size[low] > page_bytes and keys[high] - keys[low] > 1)
        if full and depth < bits:
            todo += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
            continue
        bucket[low:high], overfull[low:high] = number, full
        number += 1
    return bucket, overfull


def cell_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - FIRST_BITS).cast("long")


def bucket_of() -> Column:
    """From key and the columns of CELLS: the bucket, by the bits after the first where its cell has doubled."""
    more = F.expr(f"shiftrightunsigned(shiftleft(key, {FIRST_BITS}), 64 - extra)")
    return F.col("base") + F.when(F.col("extra") > 0, more).otherwise(F.lit(0))


def grow(keys: DataFrame, capacity: int, page_bytes: int) -> DataFrame:
    """The directory of a table (key, weight) of distinct keys: a row for each cell that has keys, 2^FIRST_BITS at most.

    Cells that are overfull double on their own, each round those that still have an overfull bucket of several keys.
    """
    spark = keys.sparkSession
    keys = keys.withColumn("cell", cell_of(F.col("key")))
    found = keys.groupBy("cell").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).collect()
    counts = {r["cell"]: (r["n"], r["bytes"]) for r in found}
    bucket, overfull = directory(counts, capacity, page_bytes)
    extra = {c: max(1, math.ceil(math.log2(max(n / capacity, size / page_bytes)))) for c, (n, size) in counts.items() if overfull[c]}

    def table() -> DataFrame:
        rows, shift = [], 0  # buckets of a doubled cell take numbers of their own; later ones move up
        for c in sorted(counts):
            rows.append((c, int(bucket[c]) + shift, extra.get(c, 0)))
            shift += (1 << extra.get(c, 0)) - 1
        return spark.createDataFrame(rows, CELLS)

    growing = set(extra)
    while growing:
        doubled = F.broadcast(table().where("extra > 0"))  # at most 2^FIRST_BITS rows
        parts = keys.join(doubled, "cell").groupBy("cell", bucket_of().alias("bucket")).agg(F.count("*").alias("n"), F.sum("weight").alias("bytes"))
        full = parts.where((F.col("n") > capacity) | ((F.col("bytes") > page_bytes) & (F.col("n") > 1))).select("cell").distinct().collect()
        growing = {r["cell"] for r in full if extra[r["cell"]] < 64 - FIRST_BITS}
        for c in growing:
            extra[c] += 1
    return table()


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (length, id): the longer, then the smaller id, null last."""
    return min((a[:2], b[:2]), key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _own(key: tuple, page: pa.Table) -> pa.Table:
    """Owner: chain the entries of each key and compare bytes; one row for each distinct text."""
    order = np.argsort(page.column("key").to_numpy(), kind="stable")
    page = page.take(pa.array(order))
    found, chain, last = [], [], None
    shas, bodies = page.column("sha").to_pylist(), page.column("body")
    n_cp, low, n = (page.column(c).to_pylist() for c in ("n_cp", "low_id", "n"))
    for i, k in enumerate(page.column("key").to_pylist()):
        if k != last:
            found += chain
            chain, last = [], k
        for link in chain:
            if bodies[link["at"]].equals(bodies[i]):
                link["best"] = _better(link["best"], (n_cp[i], low[i]))
                link["n"] += n[i]
                break
        else:
            chain.append({"key": k, "sha": shas[i], "at": i, "best": (n_cp[i], low[i]), "n": n[i]})
    found += chain
    return pa.table(
        {
            "bucket": pa.array([key[0].as_py()] * len(found), pa.int64()), "key": pa.array([x["key"] for x in found], pa.int64()),
            "sha": pa.array([x["sha"] for x in found], pa.binary()), "body": bodies.take(pa.array([x["at"] for x in found], pa.int64())),
            "n_cp": pa.array([x["best"][0] for x in found], pa.int64()), "low_id": pa.array([x["best"][1] for x in found], pa.int64()),
            "n": pa.array([x["n"] for x in found], pa.int64()),
        }
    )


def build_index(docs: DataFrame, doc_id: str, text: str, key: Column | None = None, capacity: int = CAPACITY, page_bytes: int = PAGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(entries, pages): a narrow row for each document, and the index pages of keys that several rows have.

    key: another 64-bit key of the normalised text, as tests use to make keys collide.
    """
    spark = docs.sparkSession
    body = normal(text_of(text))
    the_key = F.xxhash64(body) if key is None else key
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), the_key.alias("key"))
    facts = {"n_cp": F.length(text_of()).cast("long"), "sha": F.unhex(F.sha2(normal(text_of()), 256))}
    entries = staged(
        rows.select("doc_id", "key", *[c.alias(k) for k, c in facts.items()], F.octet_length(normal(text_of())).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")),
        "dedup-entries",
    )
    several = entries.groupBy("key").agg(F.count("*").alias("rows"), F.max("n_bytes").alias("n_bytes")).where("rows > 1")
    several = staged(several.select("key", ((F.col("n_bytes") + 64) * F.least("rows", salts(F.col("n_bytes")))).alias("weight")), "dedup-keys")
    cells = staged(grow(several, capacity, page_bytes), "dedup-directory")
    shared = join_checked(rows, several.select("key"), ["key"], "left_semi")
    shared = shared.select("doc_id", "key", *[c.alias(k) for k, c in facts.items()], normal(text_of()).alias("body"), F.spark_partition_id().alias("task"))
    placed = shared.withColumn("cell", cell_of(F.col("key"))).join(F.broadcast(cells), "cell")  # at most 2^FIRST_BITS rows
    best = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("best")
    salt = (F.col("task") % salts(F.octet_length("body"))).alias("salt")
    folded = placed.groupBy(bucket_of().alias("bucket"), "key", "sha", "body", salt).agg(best, F.count("*").alias("n"))
    folded = folded.select("bucket", "key", "sha", "body", (-F.col("best.less")).alias("n_cp"), F.col("best.id").alias("low_id"), "n")
    path = scratch(spark, "dedup-index")
    folded.groupBy("bucket").applyInArrow(_own, PAGE).write.option("compression", "zstd").parquet(path)
    return entries, spark.read.parquet(path)


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Column | None = None, capacity: int = CAPACITY, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_cp, sha, keep_id, group_size, kept."""
    entries, pages = build_index(docs, doc_id, text, key, capacity, page_bytes)
    heads = pages.select("key", "sha", F.col("low_id").alias("keep_id"), F.col("n_cp").alias("keep_cp"), F.col("n").alias("group_size"), F.lit(True).alias("found"))
    rows = join_checked(entries, heads, ["key", "sha"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    best = ~F.col("found") | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")))
    # rows that agree with the best one in text, length and id: the first of them stays
    tied = rows.where(F.col("found") & best).groupBy("key", "sha").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    tied = staged(tied, "dedup-ties")
    rows = join_checked(rows, tied, ["key", "sha"], "left")
    return rows.select(
        "doc_id", "n_cp", "sha", F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (best & F.coalesce(F.col("row") == F.col("first"), F.lit(True))).alias("kept"),
    )


def groups(docs: DataFrame, **kw) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return judged(docs, **kw).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents."""
    return groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that stay, one a text.

    Rows that agree in id, length and text without white space are told apart by nothing that counts; one of each such set stays.
    """
    like = [free_name(docs, x) for x in ("_id", "_sha", "_cp")]
    found = judged(docs).where("group_size > 1")
    sets = staged(
        found.groupBy(ident(F.col("doc_id")).alias(like[0]), F.col("sha").alias(like[1]), F.col("n_cp").alias(like[2])).agg(F.max("kept").alias("stays"), F.count("*").alias("n")), "dedup-found"
    )
    values = (ident(F.col("doc_id")), F.unhex(F.sha2(normal(text_of()), 256)), F.length(text_of()).cast("long"))
    rows = join_checked(docs.withColumns(dict(zip(like, values))), sets.where("not stays").select(*like), like, "left_anti")
    repeated = sets.where("stays and n > 1").select(*like)
    if not repeated.isEmpty():
        some = join_checked(rows, repeated, like, "left_semi").dropDuplicates(like)
        rows = join_checked(rows, repeated, like, "left_anti").unionByName(some)
    return rows.select(*docs.columns)


ORACLE_OP8 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id)
"""
