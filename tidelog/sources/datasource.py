"""Python data source ``tidelog``: a log's manifest as a batch table, a stream of segments, and a sink of segments.

Stream offsets are segment numbers, each the first that has not been read. A batch holds at most ``segmentsPerBatch`` segments in order, or all committed ones
if that isn't set, as a bounded catch-up, and a restart from a checkpoint, want. A stream ends before ``endSegment``, if that is set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo

from .. import schema as S
from .log import BlockLog, Ref
from .storage import Store


#: Segments that one task reads: a task costs more than a small file.
PER_TASK = 64


class Segments(InputPartition):
    def __init__(self, seqs: list[int]):
        super().__init__(seqs)
        self.seqs = seqs


def _rows(path: str, seqs: list[int]):
    log = BlockLog.open(Store.at(path))
    for seq in seqs:
        s = log.read_segment(seq)
        for pos, b in enumerate(s.blocks):
            yield (s.seq, s.pass_idx, pos, s.seq * s.W + pos, b.block_id, b.locator, b.num_rows)


class ManifestReader(DataSourceReader):
    """Bounds on seq choose the manifests that are opened; Spark applies every filter again."""

    def __init__(self, path: str):
        self.path, self.low, self.high = path, None, None

    def pushFilters(self, filters):
        for f in filters:
            v = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("seq",) and isinstance(v, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = v + 1 if isinstance(f, GreaterThan) else v
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = v - 1 if isinstance(f, LessThan) else v
                    self.high = high if self.high is None else min(self.high, high)
            yield f

    def partitions(self):
        seqs = [s for s in BlockLog.open(Store.at(self.path)).seqs() if (self.low is None or s >= self.low) and (self.high is None or s <= self.high)]
        return [Segments(seqs[i : i + PER_TASK]) for i in range(0, len(seqs), PER_TASK)] or [Segments([])]

    def read(self, partition):
        yield from _rows(self.path, partition.seqs)


class ManifestStream(DataSourceStreamReader):
    def __init__(self, path: str, per_batch: int | None, start: int | None, end: int | None = None):
        self.path, self.per_batch, self.start, self.end, self.at = path, per_batch, start, end, None

    def initialOffset(self):
        """The first segment asked for that the log still has."""
        return {"seq": max(self.start or 0, BlockLog.open(Store.at(self.path)).first_seq() or 0)}

    def latestOffset(self):
        if self.at is None:
            self.at = self.initialOffset()["seq"]
        log, end = BlockLog.open(Store.at(self.path)), self.at
        # a bounded batch asks for its own segments only: a listing of the log at each trigger grows as its square
        committed = set(log.seqs()).__contains__ if self.per_batch is None else log.has_segment
        most = min((x for x in (self.end, None if self.per_batch is None else self.at + self.per_batch) if x is not None), default=None)
        while (most is None or end < most) and committed(end):
            end += 1  # up to the first gap
        self.at = end
        return {"seq": end}

    def partitions(self, start, end):
        return [Segments(list(range(s, min(s + PER_TASK, end["seq"])))) for s in range(start["seq"], end["seq"], PER_TASK)]

    def read(self, partition):
        return _rows(self.path, partition.seqs)

    def commit(self, end):
        pass


@dataclass
class Written(WriterCommitMessage):
    refs: list


class SegmentWriter(DataSourceWriter):
    """Rows are references (block_id, locator, num_rows); the driver commits them as segments in the order of block_id."""

    def __init__(self, path: str, pass_idx: int):
        self.path, self.pass_idx = path, pass_idx

    def write(self, iterator):
        return Written([(r.block_id, r.locator, r.num_rows) for r in iterator])

    def commit(self, messages):
        """A segment is committed in one step, several aren't: a write that broke off among them is finished by writing the same blocks again.

        Segments that the source committed before with the same blocks and pass are passed over, so nothing is repeated.
        """
        log = BlockLog.open(Store.at(self.path))
        refs = sorted(r for m in messages if m for r in m.refs)
        if len(refs) % log.W:
            raise ValueError(f"{len(refs)} blocks are no multiple of W={log.W}")
        done = {frozenset(b.block_id for b in s.blocks) for s in map(log.read_segment, log.seqs()) if s.pass_idx == self.pass_idx and s.meta.get("writer") == "datasource"}
        for i in range(0, len(refs), log.W):
            if frozenset(r[0] for r in refs[i : i + log.W]) not in done:
                log.append([Ref(*r) for r in refs[i : i + log.W]], self.pass_idx, {"writer": "datasource"})

    def abort(self, messages):
        pass  # blocks without a committed segment are never read


class TidelogSource(DataSource):
    @classmethod
    def name(cls):
        return "tidelog"

    def schema(self):
        return S.MANIFEST

    def reader(self, schema):
        return ManifestReader(self.options["path"])

    def streamReader(self, schema):
        per = self.options.get("segmentsPerBatch")
        start, end = self.options.get("startSegment"), self.options.get("endSegment")
        return ManifestStream(self.options["path"], int(per) if per else None, int(start) if start else None, int(end) if end else None)

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options["path"], int(self.options.get("pass", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TidelogSource)
