"""Dealing, resuming and cutting, as Column builders and DataFrame transforms.

A segment has W blocks; block ``pos`` of segment ``seq`` has the global position ``seq * W + pos`` and goes to rank
``pos % n`` at step ``pos div n``. A ledger (segment, cursor, world_size) says that the first
``cursor * world_size`` positions of the segment are done.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbering import digest_key, digest_rank


def div(a: Column, b) -> Column:
    """Integer division of non-negative values."""
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b)).cast("long")


# ---- scalars, for the driver ----


def steps_per_segment(w: int, n: int) -> int:
    if n <= 0 or w % n:
        raise ValueError(f"W={w} can't be dealt to {n} ranks evenly")
    return w // n


def permitted(w: int, smallest: int, largest: int) -> bool:
    return w % math.lcm(*range(smallest, largest + 1)) == 0


def resume_start(segment: int, cursor: int, world_size: int, n: int, w: int | None = None) -> tuple[int, int]:
    """(segment, step) where n ranks go on; the step is rounded down."""
    done = cursor * world_size
    if w is not None and done > w:
        raise ValueError(f"{done} positions done in a segment of {w}")
    return (segment + 1, 0) if done == w else (segment, done // n)


def replayed_positions(cursor: int, world_size: int, n: int) -> int:
    return cursor * world_size % n


# ---- the same over DataFrames ----


def pass_order(blocks: DataFrame, seed: int, passes: int = 1) -> DataFrame:
    """Every pass's permutation of the corpus: blocks with ``pass`` and ``i``."""
    every = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long"))))
    return digest_rank(every, ["pass"], digest_key(seed, F.col("pass"), F.col("block_id")), ["block_id"], "i")


def cut_segments(order: DataFrame, w: int, tail: str = "error") -> DataFrame:
    """Cut each pass in chunks of w: rows with ``chunk`` and ``slot``. The tail is refused, dropped or filled from the pass's head."""
    if tail not in ("error", "drop", "wrap"):
        raise ValueError(f"tail must be error, drop or wrap, not {tail!r}")
    size = order.groupBy("pass").agg(F.count("*").alias("_n"))
    rows = order.join(F.broadcast(size), "pass")  # a row for each pass
    if tail == "error":
        fits = F.when(F.col("_n") % w == 0, F.col("i")).otherwise(F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(f" blocks are no multiple of W={w}"))).cast("long"))
        rows = rows.withColumn("i", fits)
    elif tail == "drop":
        rows = rows.where(F.col("i") < div(F.col("_n"), w) * w)
    else:
        # row i stands again at i + k * n as long as that is below the padded length
        padded = F.ceil(F.col("_n") / w).cast("long") * w
        times = F.when(F.col("i") < padded % F.col("_n"), div(padded, F.col("_n")) + 1).otherwise(div(padded, F.col("_n")))
        rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).withColumn("i", F.col("i") + F.col("_k") * F.col("_n")).drop("_k")
    return rows.drop("_n").withColumn("chunk", div(F.col("i"), w)).withColumn("slot", F.col("i") % w)


def manifest(chunks: DataFrame, w: int, seed: int) -> DataFrame:
    """Number the chunks of all passes as segments and shuffle within each: seq, pos, position."""
    per_pass = chunks.groupBy("pass").agg((F.max("chunk") + 1).alias("_chunks"))
    before = W.orderBy("pass").rowsBetween(W.unboundedPreceding, -1)
    base = per_pass.select("pass", F.coalesce(F.sum("_chunks").over(before), F.lit(0)).alias("_base"))  # a row for each pass
    rows = chunks.join(F.broadcast(base), "pass").withColumn("seq", (F.col("_base") + F.col("chunk")).cast("long")).drop("_base")
    inside = W.partitionBy("seq").orderBy(digest_key(seed, F.col("seq"), F.col("block_id")), "block_id", "slot")
    rows = rows.withColumn("pos", (F.row_number().over(inside) - 1).cast("long"))
    return rows.withColumn("position", F.col("seq") * w + F.col("pos"))


def batch_plan(blocks: DataFrame, w: int, seed: int, passes: int = 1, tail: str = "drop") -> DataFrame:
    return manifest(cut_segments(pass_order(blocks, seed, passes), w, tail), w, seed)


def positions(segments: DataFrame, w: int) -> DataFrame:
    """(seq, position) of every position that the segments own."""
    return segments.select("seq", F.explode(F.sequence(F.col("seq") * w, F.col("seq") * w + (w - 1))).alias("position"))


def deal(plan: DataFrame, n: int) -> DataFrame:
    """plan with rank and step for n ranks."""
    return plan.withColumn("rank", F.col("pos") % n).withColumn("step", div(F.col("pos"), n))


def lane(plan: DataFrame, rank: int, n: int, start_step: int = 0) -> DataFrame:
    if not 0 <= rank < n:
        raise ValueError(f"rank {rank} of {n}")
    return deal(plan, n).where((F.col("rank") == rank) & (F.col("step") >= start_step))


def resume(plan: DataFrame, w: int, segment: int, cursor: int, world_size: int, n: int) -> DataFrame:
    """What n ranks still have to read after a ledger of any world size."""
    seq, step = resume_start(segment, cursor, world_size, n, w)
    return deal(plan.where(F.col("seq") >= seq), n).where((F.col("seq") > seq) | (F.col("step") >= step))


def resume_columns(w: Column, segment: Column, cursor: Column, world_size: Column, n: Column) -> dict[str, Column]:
    done = cursor * world_size
    whole = done == w
    return {
        "start_segment": F.when(whole, segment + 1).otherwise(segment),
        "start_step": F.when(whole, F.lit(0).cast("long")).otherwise(F.floor(done / n).cast("long")),
        "replayed": F.when(whole, F.lit(0).cast("long")).otherwise(done % n),
    }


def contiguous_prefix(segments: DataFrame, start: int | None = None) -> DataFrame:
    """Segments from the lowest (or ``start``) up to the first gap: gaps and islands over the list of numbers."""
    rows = segments if start is None else segments.where(F.col("seq") >= start)
    first = F.min("seq").over(W.partitionBy()) if start is None else F.lit(start)
    island = F.col("seq") - F.row_number().over(W.orderBy("seq")) + 1
    return rows.withColumn("_ok", island == first).where("_ok").drop("_ok")


def next_pass_differs(segments: DataFrame, ended: bool) -> DataFrame:
    """segments with ``boundary``: the next segment has another pass, or there is none and the log has ended; unknown is false."""
    following = F.lead(F.struct("seq", "pass")).over(W.orderBy("seq"))
    known = F.col("_next").isNotNull() & (F.col("_next.seq") == F.col("seq") + 1)
    return segments.withColumn("_next", following).withColumn("boundary", F.when(known, F.col("_next.pass") != F.col("pass")).otherwise(F.lit(ended))).drop("_next")


def first_refs(manifest_rows: DataFrame) -> DataFrame:
    """The distinct blocks of a log: of each id the reference that stands first."""
    return manifest_rows.groupBy("block_id").agg(F.min_by("num_rows", "position").alias("num_rows"), F.min("position").alias("first_position"))


def segment_anchors(items: DataFrame, item: str, per_segment: int, segments: int, seed: int, n_items: int) -> DataFrame:
    """Consecutive slices of per-pass permutations of the items: (seq, i, pass, item), wrapping across passes."""
    passes = (segments * per_segment - 1) // n_items + 1
    every = items.select(F.col(item).alias("item")).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long"))))
    ranked = digest_rank(every, ["pass"], digest_key(seed, F.col("pass"), F.col("item")), ["item"], "offset")
    at = F.col("pass") * n_items + F.col("offset")
    rows = ranked.withColumn("seq", div(at, per_segment)).withColumn("i", at % per_segment).where(F.col("seq") < segments)
    return rows.withColumn("segment_pass", div(F.col("seq") * per_segment, n_items)).select("seq", "i", "segment_pass", "item")
