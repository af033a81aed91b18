"""Verification queries over audit trails: each gives problems as rows (check_name, subject, problem); none means passed.

Everything is an aggregation or a join by position, segment or attempt; expected positions come from sequences
per segment, so no check collects a trail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import checkpoint_name_col
from ..plans import planner

PROBLEM = "check_name string, subject long, problem string"


def _problems(df: DataFrame, check: str, subject: Column, problem: str | Column) -> DataFrame:
    text = F.lit(problem) if isinstance(problem, str) else problem
    return df.select(F.lit(check).alias("check_name"), subject.cast("long").alias("subject"), text.alias("problem"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_attempt(records: DataFrame) -> DataFrame:
    return records.groupBy("attempt").agg(F.count("*").alias("records"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


def summary(records: DataFrame) -> DataFrame:
    """A row for each attempt; world sizes and ranks as sorted, comma-joined strings."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)).cast("array<string>"), ",")
    return records.groupBy("attempt").agg(
        listed("world_size").alias("world_sizes"), listed("rank").alias("ranks"), F.count("*").alias("records"), F.min("segment").alias("first_segment"),
        F.max("segment").alias("last_segment"), F.min("position").alias("first_position"), F.max("position").alias("last_position"),
    )


def dealing(records: DataFrame, w: int) -> DataFrame:
    """Records whose position isn't segment * W + step * n + rank."""
    right = F.col("segment") * w + F.col("step") * F.col("world_size") + F.col("rank")
    return _problems(records.where(F.col("position") != right), "dealing", F.col("position"), "dealt to the wrong rank or step")


def coverage(records: DataFrame, w: int) -> DataFrame:
    """Positions of touched segments that no record, or more than one, has; and positions outside their record's segment."""
    counts = records.groupBy("position").agg(F.count("*").alias("n"))
    expected = planner.positions(records.select(F.col("segment").alias("seq")).distinct(), w).select("position")
    rows = expected.join(counts, "position", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    owned = expected.withColumn("owned", F.lit(True))
    extra = counts.join(owned, "position", "left_anti")
    return union(
        _problems(rows.where("n = 0"), "coverage", F.col("position"), "missing"),
        _problems(rows.where("n > 1"), "coverage", F.col("position"), "consumed more than once"),
        _problems(extra, "coverage", F.col("position"), "outside the touched segments"),
    )


def duplicates(records: DataFrame) -> DataFrame:
    twice = records.groupBy("attempt", "position").agg(F.count("*").alias("n")).where("n > 1")
    return _problems(twice, "duplicates", F.col("position"), F.concat(F.lit("consumed "), F.col("n").cast("string"), F.lit(" times in attempt "), F.col("attempt").cast("string")))


def rank_balance(records: DataFrame) -> DataFrame:
    """Ranks that consumed another number of blocks than the most."""
    counts = records.groupBy("rank").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    rows = counts.join(F.broadcast(most), F.col("n") < F.col("most"))  # one row
    return _problems(rows, "rank_balance", F.col("rank"), F.concat(F.col("n").cast("string"), F.lit(" blocks of "), F.col("most").cast("string")))


def one_attempt(records: DataFrame) -> DataFrame:
    n = records.agg(F.count_distinct("attempt").alias("n"))
    return _problems(n.where("n <> 1"), "one_attempt", F.col("n"), "a run without failures has one attempt")


def happy_path(records: DataFrame, w: int) -> DataFrame:
    return union(one_attempt(records), dealing(records, w), coverage(records, w), rank_balance(records))


def cadence(ledgers: DataFrame, w: int, every_k: int | None, expected: int | None = None) -> DataFrame:
    """ledgers (name, segment, cursor, world_size, run_attempt): each cursor is a multiple of k or the segment's end, and names fit."""
    ok = F.col("cursor") == F.floor(F.lit(w) / F.col("world_size"))
    if every_k is not None:
        ok = ok | (F.col("cursor") % every_k == 0)
    named = checkpoint_name_col(F.col("segment"), F.col("cursor"), F.col("world_size"), F.col("run_attempt"))
    parts = [
        _problems(ledgers.where(~ok), "cadence", F.col("segment") * w + F.col("cursor") * F.col("world_size"), "neither a multiple of k nor the segment's end"),
        _problems(ledgers.where(F.col("name") != named), "cadence", F.col("segment") * w + F.col("cursor") * F.col("world_size"), F.concat(F.lit("should be called "), named)),
    ]
    if expected is not None:
        n = ledgers.agg(F.count("*").alias("n"))
        parts.append(_problems(n.where(F.col("n") != expected), "cadence", F.col("n"), f"expected {expected} checkpoints"))
    return union(*parts)


def time_spacing(ledgers: DataFrame, w: int, poll_every: int, reports: int | None = None) -> DataFrame:
    """Checkpoints of a time budget: two at least, one world size, poll_every steps apart, on step boundaries."""
    rows = ledgers.withColumn("at", F.col("segment") * w + F.col("cursor") * F.col("world_size"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_distinct("world_size").alias("sizes"), F.min("world_size").alias("least"))
    gaps = rows.withColumn("before", F.lag("at").over(W.orderBy("at"))).crossJoin(F.broadcast(sizes.select("least")))  # checkpoints of one run, and one row
    bad = (F.col("cursor") <= 0) | (F.col("cursor") * F.col("world_size") > w)
    parts = [
        _problems(sizes.where("n < 2"), "time_spacing", F.col("n"), "fewer than two checkpoints"),
        _problems(sizes.where("sizes > 1"), "time_spacing", F.col("sizes"), "several world sizes"),
        _problems(gaps.where(F.col("at") - F.col("before") < F.col("least") * poll_every), "time_spacing", F.col("at"), F.concat(F.lit("closer than the poll to "), F.col("before").cast("string"))),
        _problems(rows.where(bad), "time_spacing", F.col("at"), "not a step boundary"),
    ]
    if reports is not None:
        parts.append(_problems(sizes.where(~F.lit(reports).isin(F.col("n"), F.col("n") + 1)), "time_spacing", F.col("n"), f"{reports} reports"))
    return union(*parts)


def report_count(spark, reports: int, expected: int) -> DataFrame:
    rows = [] if reports == expected else [("report_count", reports, f"expected {expected}")]
    return spark.createDataFrame(rows, PROBLEM)


def hook_provenance(records: DataFrame, segments: DataFrame, w: int, initial: int, writer: str = "remine", tolerance: float = 0.05) -> DataFrame:
    """Segments from ``initial`` on: written by the hook after the segment before, committed between its end and their first use, read exactly, no old block."""
    used = records.groupBy("segment").agg(F.min("ts").alias("first_ts"), F.sort_array(F.collect_set("block_id")).alias("ids"))
    ends = records.where("rank = 0").groupBy("segment").agg(F.max("ts").alias("end0")).select((F.col("segment") + 1).alias("segment"), "end0")
    log = segments.select(
        F.col("seq").alias("segment"), F.lit(True).alias("known"), F.col("meta")["writer"].alias("writer"), F.col("meta")["mined_after_segment"].cast("long").alias("after"),
        F.col("meta")["created_at"].cast("double").alias("created"), F.sort_array(F.array_distinct(F.transform("blocks", lambda b: b["block_id"]))).alias("own"),
    )
    rows = used.join(log, "segment", "left").join(ends, "segment", "left")
    mined = rows.where(F.col("known") & (F.col("segment") >= initial))
    base = segments.where(F.col("seq") < initial).select(F.explode(F.transform("blocks", lambda b: b["block_id"])).alias("block_id")).distinct()
    reused = records.where(F.col("segment") >= initial).join(base, "block_id", "left_semi").select("segment").distinct()
    return union(
        happy_path(records, w),
        _problems(rows.where("known is null"), "hook", F.col("segment"), "consumed but not in the log"),
        _problems(mined.where(~(F.col("writer").eqNullSafe(writer) & F.col("after").eqNullSafe(F.col("segment") - 1))), "hook", F.col("segment"), "not written by the hook after the segment before"),
        _problems(mined.where(F.col("created").isNull() | (F.col("created") > F.col("first_ts") + tolerance)), "hook", F.col("segment"), "committed after its first use"),
        _problems(mined.where((F.col("created") <= F.col("first_ts") + tolerance) & (F.col("created") + tolerance < F.col("end0"))), "hook", F.col("segment"), "committed before the segment before was done"),
        _problems(mined.where(F.col("ids") != F.col("own")), "hook", F.col("segment"), "consumed other blocks than its own"),
        _problems(reused, "hook", F.col("segment"), "re-used blocks of the base corpus"),
    )


def determinism(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b (rank, ordinal, block_id): for each rank the first ordinal at which the runs differ; ranks that only one has."""
    left, right = a.select("rank", "ordinal", F.col("block_id").alias("x")), b.select("rank", "ordinal", F.col("block_id").alias("y"))
    both = left.join(right, ["rank", "ordinal"], "full_outer")
    per = both.groupBy("rank").agg(
        F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("ordinal"))).alias("at"), F.count("x").alias("in_a"), F.count("y").alias("in_b"),
    )
    return union(
        _problems(per.where("in_a = 0 or in_b = 0"), "determinism", F.col("rank"), "only one run has this rank"),
        _problems(per.where("in_a > 0 and in_b > 0 and at is not null"), "determinism", F.col("rank"), F.concat(F.lit("differs at index "), F.col("at").cast("string"))),
    )


def resumed(records: DataFrame, w: int, start: int | None = None, ledger: tuple[int, int] | None = None, segments: int | None = None) -> DataFrame:
    """A resumed run: positions from the start to the end of its last segment, each once.

    ledger: (segment, positions done); the start follows by the resume rule from the world size of the first attempt.
    """
    facts = records.agg(F.max("segment").alias("last"), F.min_by("world_size", "attempt").alias("n"))
    if ledger is not None:
        seg, done = ledger
        whole = done == w
        first = F.lit((seg + 1) * w) if whole else F.lit(seg * w) + F.floor(F.lit(done) / F.col("n")) * F.col("n")
    elif start is not None:
        first = F.lit(start)
    else:
        raise ValueError("a start or a ledger is needed")
    facts = facts.withColumn("first", first.cast("long"))
    expected = facts.where(F.col("first") < (F.col("last") + 1) * w).select(F.explode(F.sequence(F.col("first"), (F.col("last") + 1) * w - 1)).alias("position"))
    counts = records.groupBy("position").agg(F.count("*").alias("n"))
    both = expected.withColumn("due", F.lit(True)).join(counts, "position", "full_outer")
    parts = [
        dealing(records, w),
        _problems(both.where("n is null"), "resume", F.col("position"), "missing"),
        _problems(both.where("due is null"), "resume", F.col("position"), "extra"),
        _problems(both.where("n > 1"), "resume", F.col("position"), "consumed more than once"),
    ]
    if segments is not None:
        parts.append(_problems(facts.where(F.col("last") + 1 != segments), "resume", F.col("last") + 1, f"expected {segments} segments"))
    return union(*parts)


def recovery(records: DataFrame, w: int, every_k: int = 1, lag: int = 0, least_attempts: int = 2, segments: int | None = None, world_sizes: list[int] | None = None) -> DataFrame:
    """Several attempts over one log: no gap, step boundaries, bounded replay, all positions covered."""
    per = records.groupBy("attempt").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.min("world_size").alias("n"), F.count_distinct("world_size").alias("sizes")
    )
    order = W.orderBy("attempt")  # a row for each attempt
    moves = per.select("attempt", "first", "n", "sizes", F.lag("attempt").over(order).alias("before"), F.lag("last").over(order).alias("last_before"), F.lag("n").over(order).alias("n_before"))
    replay = records.select(F.col("attempt").alias("before"), "position").join(F.broadcast(moves.select("attempt", "before", "first")), "before").groupBy("attempt").agg(
        F.count_if(F.col("position") >= F.col("first")).alias("replayed")
    )
    moved = moves.where("before is not null").join(replay, "attempt")
    bound = (2 + lag) * every_k * F.col("n_before") + F.col("n")
    n_attempts = per.agg(F.count("*").alias("n"))
    last = records.agg(F.max("segment").alias("last"))
    due = last.select(F.explode(F.sequence(F.lit(0).cast("long"), (F.col("last") + 1) * w - 1)).alias("position"))
    parts = [
        dealing(records, w), duplicates(records),
        _problems(n_attempts.where(F.col("n") < least_attempts), "recovery", F.col("n"), f"fewer than {least_attempts} attempts"),
        _problems(per.where("sizes > 1"), "recovery", F.col("attempt"), "mixed world sizes"),
        _problems(moved.where("first > last_before + 1"), "recovery", F.col("attempt"), F.concat(F.lit("gap after "), F.col("last_before").cast("string"))),
        _problems(moved.where((F.col("first") % w) % F.col("n") != 0), "recovery", F.col("attempt"), "does not start at a step boundary"),
        _problems(moved.where(F.col("replayed") > bound), "recovery", F.col("attempt"), F.concat(F.lit("replays "), F.col("replayed").cast("string"))),
        _problems(due.join(records.select("position"), "position", "left_anti"), "recovery", F.col("position"), "never consumed"),
    ]
    if segments is not None:
        parts.append(_problems(last.where(F.col("last") + 1 != segments), "recovery", F.col("last") + 1, f"expected {segments} segments"))
    if world_sizes is not None:
        parts.append(_problems(transition(per, world_sizes), "recovery", F.col("attempt"), F.concat(F.lit("world size "), F.col("n").cast("string"))))
    return union(*parts)


def transition(per_attempt: DataFrame, world_sizes: list[int]) -> DataFrame:
    """Attempts whose world size isn't the one expected at their place."""
    want = F.get(F.array(*[F.lit(x) for x in world_sizes]), (F.row_number().over(W.orderBy("attempt")) - 1))
    return per_attempt.withColumn("_want", want).where(~F.col("n").eqNullSafe(F.col("_want"))).drop("_want")


def segment_times(records: DataFrame) -> DataFrame:
    return records.groupBy("segment").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))


def segment_gaps(records: DataFrame) -> DataFrame:
    rows = segment_times(records)  # a row for each segment
    return rows.withColumn("gap", F.col("start") - F.lag("start").over(W.orderBy("segment"))).select("segment", "start", "stop", "gap")


def streaming(records: DataFrame, w: int, commits: DataFrame, least_gap: float, segments: int | None = None, tolerance: float = 0.05) -> DataFrame:
    """commits (segment, committed): nothing is read before its commit, and readers waited for the producer at least once."""
    times = segment_times(records).join(commits, "segment", "left")
    order = W.orderBy("segment")
    times = times.withColumn("stop_before", F.lag("stop").over(order)).withColumn("gap", F.col("start") - F.lag("start").over(order))
    whole = times.agg(
        F.count_if(F.col("committed") > F.col("stop_before") + tolerance).alias("waited"), F.max("gap").alias("widest"), F.count("*").alias("n"), F.max("segment").alias("last"),
        F.min("segment").alias("first"),
    )
    parts = [
        happy_path(records, w),
        _problems(times.where("committed is null"), "streaming", F.col("segment"), "no commit time"),
        _problems(times.where(F.col("committed") > F.col("start") + tolerance), "streaming", F.col("segment"), "consumed before its commit"),
        _problems(whole.where("waited = 0"), "streaming", F.col("n"), "readers never waited for the producer"),
        _problems(whole.where(F.col("widest") < least_gap), "streaming", F.col("n"), "segments start closer than the producer's pace"),
    ]
    if segments is not None:
        parts.append(_problems(whole.where((F.col("n") != segments) | (F.col("first") != 0) | (F.col("last") != segments - 1)), "streaming", F.col("n"), f"expected segments 0 to {segments - 1}"))
    return union(*parts)


def streaming_run(spark, log, run: str, commits: DataFrame, least_gap: float, segments: int, points, keep: int) -> DataFrame:
    """All that a finished streaming run leaves in its store: trail, end of the log, and the window behind the newest checkpoint.

    points: the run's Checkpoints. Files of blocks/ that aren't blocks are passed over.
    """
    from ..sources.audit import read_audit

    parts = [streaming(read_audit(spark, log.store, run), log.W, commits, least_gap, segments)]
    said = [] if log.ended() else [("streaming_run", None, "the producer did not end the log")]
    last = max((x.segment for x in points.ledgers().values()), default=None)
    if last is None:
        said.append(("streaming_run", None, "no checkpoint with a ledger"))
    else:
        files = [(f"blocks/{name}",) for name in log.store.names("blocks") if name.endswith(".parquet")]
        parts.append(retention(log.manifest(spark).select("seq", "locator"), spark.createDataFrame(files, "locator string"), last, keep))
    return union(*parts, spark.createDataFrame(said, PROBLEM))


def retention(kept: DataFrame, files: DataFrame, last_checkpoint: int, keep: int) -> DataFrame:
    """kept (seq, locator) and files (locator): the window starts where it should, has no hole, and holds exactly its blocks."""
    bounds = kept.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("n"))
    start = max(0, last_checkpoint - keep)
    missing = kept.select("locator").distinct().join(files, "locator", "left_anti")
    some = F.broadcast(bounds.where("n > 0").select("n"))  # one row: an empty log says nothing of the files
    orphans = files.join(kept.select("locator"), "locator", "left_anti").join(some, F.lit(True))
    name = lambda what: F.concat(F.lit(what), F.col("locator"))
    return union(
        _problems(bounds.where("n = 0"), "retention", F.col("n"), "no segments left in the log"),
        _problems(bounds.where(F.col("first") != start), "retention", F.col("first"), f"the window should start at {start}"),
        _problems(bounds.where("last - first + 1 <> n"), "retention", F.col("n"), "the window has a hole"),
        _problems(missing, "retention", F.lit(None), name("missing ")),
        _problems(orphans, "retention", F.lit(None), name("orphan ")),
    )
