"""Batch production of a log: a plan of references, made as rows, and its segments committed in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from ..plans.shuffle import exact_order
from ..sources.blocks import REFS, verify_blocks
from ..sources.log import BlockLog, Ref, Segment

TAILS = ("error", "drop", "wrap")


def chunks(order: list, w: int, tail: str = "error") -> Iterator[list]:
    """An order in pieces of w. What is left over is refused, dropped, or filled up from the order's head, round and round if that is short."""
    if tail not in TAILS:
        raise ValueError(f"tail must be one of {TAILS}, not {tail!r}")
    if tail == "error" and len(order) % w:
        raise ValueError(f"{len(order)} blocks are no multiple of W={w}")
    pieces = len(order) // w if tail != "wrap" else -(-len(order) // w)
    return ([order[(low + i) % len(order)] for i in range(w)] for low in range(0, pieces * w, w))


def batch_plan(blocks: list[Ref], w: int, seed: int, passes: int = 1, tail: str = "error") -> list[tuple[int, int, int, Ref]]:
    """Rows (seq, pass, slot, block) of all passes; orders are the exact ones. The DataFrame form is planner.batch_plan, in the digest order."""
    if passes <= 0:
        raise ValueError("passes must be positive")
    names = [b.block_id for b in blocks]
    if len(set(names)) < len(names):
        raise ValueError("a block id stands twice in the corpus")
    pieces = [(number, piece) for number in range(passes) for piece in chunks(exact_order(blocks, seed, number), w, tail)]
    if not pieces:
        raise ValueError("the plan has no segment")
    return [(seq, number, slot, block) for seq, (number, piece) in enumerate(pieces) for slot, block in enumerate(piece)]


def write_batch(log: BlockLog, blocks: list[Ref], passes: int = 1, tail: str = "error", spark: SparkSession | None = None) -> list[Segment]:
    """Plan blocks that tasks have written, check their files once, commit segment by segment, end the log."""
    rows = batch_plan(blocks, log.W, log.seed, passes, tail)
    if spark is not None:
        verify_blocks(spark.createDataFrame([(b.block_id, b.locator, b.num_rows) for b in blocks], REFS), log.store)
    done = [log.append([block for *_, block in rows[at : at + log.W]], rows[at][1], {"writer": "batch"}) for at in range(0, len(rows), log.W)]
    log.end()
    return done


def distinct_refs(segments: list[Segment]) -> list[Ref]:
    """The corpus of an existing log: the first reference of each id, by id."""
    first = {b.block_id: b for s in reversed(segments) for b in reversed(s.blocks)}
    return [first[name] for name in sorted(first)]
