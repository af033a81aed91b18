"""Consuming a live log: segments as a stream, hooks and retention at each segment's end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hooks import run_hooks
from ..plans.planner import deal
from ..sources.datasource import register
from ..sources.log import BlockLog


def segment_stream(spark: SparkSession, log: BlockLog, start: int | None = None, per_batch: int | None = None, end: int | None = None) -> DataFrame:
    """The log's manifest as a stream: rows of committed segments in order, up to the first gap, or to the segment before end."""
    register(spark)
    reader = spark.readStream.format("tidelog").option("path", log.store.uri)
    if start is not None:
        reader = reader.option("startSegment", start)
    if per_batch is not None:
        reader = reader.option("segmentsPerBatch", per_batch)
    if end is not None:
        reader = reader.option("endSegment", end)
    return reader.load()


def stretches(first: int, end: int, per_batch: int, most: int, triggers: int = 16) -> list[tuple[int, int]]:
    """Segments first to end - 1 in at most `most` runs of whole triggers, of about `triggers` triggers or more each: (first, end) of each run."""
    n = -(-(end - first) // per_batch)
    runs = max(1, min(most, n // triggers))
    cuts = [min(end, first + n * k // runs * per_batch) for k in range(runs + 1)]
    return [(low, high) for low, high in zip(cuts, cuts[1:]) if low < high]


_FILES = "spark.sql.streaming.checkpointFileManagerClass"


@contextmanager
def plain_checkpoints(spark: SparkSession, checkpoint: str) -> Iterator[None]:
    """Streams started within write the files of a local checkpoint by FileSystem instead of FileContext, which starts processes for each of them.

    What FileContext adds is that two writers of one checkpoint notice each other: this is for checkpoints that are a stream's own.
    """
    before = spark.conf.get(_FILES, None)
    if before is not None or not checkpoint.startswith(("file:", "/")):
        yield
        return
    spark.conf.set(_FILES, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    try:
        yield
    finally:
        spark.conf.unset(_FILES)


def consume_committed(spark: SparkSession, log: BlockLog, per_batch: int, on_batch: Callable[[DataFrame, int], None], *, checkpoint: str, streams: int = 6) -> None:
    """Read the committed segments up to the first gap, per_batch a trigger, by several streams at once; on_batch(rows, stretch) is called at least once for each trigger.

    A trigger costs about the same whatever it holds (its offsets and its commit are files, one after the other), so a long log is cut into stretches,
    each a stream with a checkpoint of its own. Triggers of a stretch come in order, those of different stretches don't.
    """
    seqs = log.seqs()
    if not seqs:
        return
    first, started = seqs[0], []
    end = first + next((i for i, seq in enumerate(seqs) if seq != first + i), len(seqs))
    try:
        with plain_checkpoints(spark, checkpoint):
            for k, (low, high) in enumerate(stretches(first, end, per_batch, streams)):
                stream = segment_stream(spark, log, low, per_batch, high).writeStream.foreachBatch(lambda rows, _, k=k: on_batch(rows, k))
                started.append(stream.option("checkpointLocation", f"{checkpoint}/{k:03d}").trigger(processingTime="0 seconds").start())
        for query in started:
            query.processAllAvailable()
            query.stop()
    finally:
        for query in started:
            query.stop()


def consume(spark: SparkSession, log: BlockLog, n: int, on_segment: Callable[[DataFrame, int], None], *, checkpoint: str, start: int = 0, hooks=(), context=None, retention: int | None = None, available_now: bool = True):
    """Deal each segment to n ranks and hand it to on_segment(rows, seq), in order and at least once.

    Hooks run after each segment. Retention runs when the next trigger begins, behind segments whose offsets are committed, so
    a trigger that is tried again finds all of its segments. Segments that a hook appends are read by the next trigger;
    ``drain`` runs this again until the log has ended.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        seqs = [r["seq"] for r in rows.select("seq").distinct().orderBy("seq").collect()]  # the segments of one trigger
        if seqs and retention is not None:
            log.gc(spark, seqs[0] - 1 - retention)
        for seq in seqs:
            on_segment(deal(rows.where(F.col("seq") == seq), n), seq)
            run_hooks(hooks, log, seq, context)
        rows.unpersist()

    query = segment_stream(spark, log, start).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True) if available_now else query.trigger(processingTime="1 second")
    return query.start()


def drain(spark: SparkSession, log: BlockLog, n: int, on_segment, *, checkpoint: str, poll_s: float = 0.2, rounds: int = 1000, retention: int | None = None, **kw) -> None:
    """Consume until the log has ended and all of it has been read."""
    import time

    done = [-1]

    def seen(rows, seq):
        on_segment(rows, seq)
        done[0] = max(done[0], seq)

    for _ in range(rounds):
        ended = log.ended()
        consume(spark, log, n, seen, checkpoint=checkpoint, retention=retention, **kw).awaitTermination()
        if retention is not None:
            log.gc(spark, done[0] - retention)
        if ended and done[0] >= (log.last_seq() if log.last_seq() is not None else -1):
            return
        time.sleep(poll_s)
    raise TimeoutError("the log did not end")
