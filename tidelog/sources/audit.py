"""Audit trails: JSON lines, a file for each (attempt, rank, part), whose order within a rank is file order."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schema as S
from ..functions.names import AUDIT_FILE, audit_file
from .storage import Store

PART_LINES = 10_000


def read_audit(spark: SparkSession, store: Store, run: str) -> DataFrame:
    """Records with part and line; files of other names and blank lines are passed over."""
    names = [n for n in store.names(f"audit/{run}") if AUDIT_FILE.match(n)]
    if not names:
        return spark.createDataFrame([], S.AUDIT).withColumns({"part": F.lit(0), "line": F.lit(0)})
    raw = spark.read.option("wholetext", True).text([store.path(f"audit/{run}/{n}") for n in names]).withColumn("name", F.col("_metadata.file_name"))
    part = F.regexp_extract("name", r"^\d+-\d+\.(\d+)\.jsonl$", 1)
    lines = raw.select(F.when(part == "", F.lit("0")).otherwise(part).cast("int").alias("part"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return lines.where(F.trim("text") != "").select(F.from_json("text", S.AUDIT).alias("r"), "part", "line").select("r.*", "part", "line")


def ordinals(records: DataFrame) -> DataFrame:
    """records with the rank's running number in file order (never by time)."""
    order = W.partitionBy("rank").orderBy("attempt", "part", "line")
    return records.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def next_attempt(store: Store, run: str) -> int:
    return max((int(m[1]) + 1 for n in store.names(f"audit/{run}") if (m := AUDIT_FILE.match(n))), default=0)


class AuditWriter:
    """A rank's trail. In a local folder every line is on disk when append returns; elsewhere files can't grow, so the trail is in parts
    of at most part_lines lines, and a flush rewrites the open part."""

    def __init__(self, store: Store, run: str, attempt: int, rank: int, part_lines: int = PART_LINES):
        self.store, self.part_lines, self.lines, self.closed = store, part_lines, [], False
        self.name = lambda part: f"audit/{run}/{audit_file(attempt, rank, part)}"
        taken = [int(m[3] or 0) for n in store.names(f"audit/{run}") if (m := AUDIT_FILE.match(n)) and (int(m[1]), int(m[2])) == (attempt, rank)]
        self.part = max(taken) + 1 if taken else 0
        self._put()  # claims the attempt
        path = store.local_path(self.name(self.part))
        self.file = open(path, "a", encoding="utf-8") if path else None

    def _put(self) -> None:
        self.store.write(self.name(self.part), "".join(line + "\n" for line in self.lines).encode())

    def append(self, record: dict) -> None:
        if self.closed:
            raise ValueError("the trail is closed")
        line = json.dumps({f.name: record[f.name] for f in S.AUDIT.fields}, sort_keys=True)
        if self.file:
            self.file.write(line + "\n")
            self.file.flush()
            return
        self.lines.append(line)
        if len(self.lines) >= self.part_lines:
            self._put()
            self.part, self.lines = self.part + 1, []

    def flush(self) -> None:
        if self.lines and not self.closed:
            self._put()

    def close(self) -> None:
        self.flush()
        if self.file and not self.closed:
            self.file.close()
        self.closed = True


def write_audit(records: DataFrame, store: Store, run: str) -> int:
    """Write a table of records, a file a rank and attempt, in the order of position; the number of lines."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["position"], r["ts"]))
        text = "".join(json.dumps(r, sort_keys=True) + "\n" for r in rows)
        store.write(f"audit/{run}/{audit_file(key[0].as_py(), key[1].as_py())}", text.encode())
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    written = records.select(*[f.name for f in S.AUDIT.fields]).groupBy("attempt", "rank").applyInArrow(one, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
