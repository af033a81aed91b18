"""Checkpoint policies over the table of steps.

A policy is a set of tests on single steps and of time budgets; it fires where any of them does. Tests are written once and
serve as Column predicates and on one step alike. Budgets depend on the checkpoints before, so steps of a policy that has
one are folded in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One completed step: number within the segment (from 1), steps a segment, whether the pass ends, elapsed seconds."""

    step: int
    steps: int
    pass_ends: bool = False
    elapsed: float = 0.0


class Policy:
    """tests: functions of a step's fields that use only operators Columns have too. budgets: (seconds, poll).

    A budget is due on every poll-th step of the run if so many seconds have passed since the last checkpoint, whoever asked for that.
    """

    def __init__(self, *tests: Callable[[Any], Any], budgets: tuple[tuple[float, int], ...] = ()):
        self.tests, self.budgets = tests, tuple(budgets)
        self.taken, self.last = 0, 0.0  # steps so far, and when the last checkpoint was

    def column(self) -> Column | None:
        """The predicate over (step, steps, pass_ends); None if only the fold can decide."""
        fields = SimpleNamespace(**{c: F.col(c) for c in ("step", "steps", "pass_ends")})
        return None if self.budgets else reduce(or_, (test(fields) for test in self.tests), F.lit(False))

    def decide(self, s: Step) -> bool:
        """Told of each step once, in order."""
        self.taken += 1
        waited = [self.taken % poll == 0 and s.elapsed - self.last >= seconds for seconds, poll in self.budgets]
        fires = any(waited) or any(test(s) for test in self.tests)
        if fires:
            self.checkpointed(s)
        return fires

    def checkpointed(self, s: Step) -> None:
        """Told after each checkpoint, whoever asked for it."""
        self.last = s.elapsed


def Never() -> Policy:
    return Policy()


def EveryKSteps(k: int) -> Policy:
    if k <= 0:
        raise ValueError("k must be positive")
    return Policy(lambda s: (s.step > 0) & (s.step % k == 0))


def SegmentEnd() -> Policy:
    return Policy(lambda s: s.step == s.steps)


def PassEnd() -> Policy:
    return Policy(lambda s: (s.step == s.steps) & s.pass_ends)


def TimeBudget(seconds: float, poll_every: int = 1) -> Policy:
    if seconds <= 0 or poll_every <= 0:
        raise ValueError("seconds and poll_every must be positive")
    return Policy(budgets=((seconds, poll_every),))


def AnyOf(members: list[Policy]) -> Policy:
    if not members:
        raise ValueError("a choice needs a policy at least")
    return Policy(*(t for m in members for t in m.tests), budgets=tuple(b for m in members for b in m.budgets))


def build_policy(kind: str = "any", every_k: int | None = None, time_budget_s: float | None = None, poll_every: int = 1) -> Policy:
    """By the names of the configuration; ``any`` takes the parts that are set, and both ends."""
    steps = [EveryKSteps(every_k)] if every_k is not None else []
    budget = [TimeBudget(time_budget_s, poll_every)] if time_budget_s is not None else []
    made = {"never": [Never()], "every_k": steps, "segment_end": [SegmentEnd()], "pass_end": [PassEnd()], "time": budget, "any": [*steps, SegmentEnd(), PassEnd(), *budget]}
    if kind not in made:
        raise ValueError(f"unknown policy {kind!r}")
    if not made[kind]:
        raise ValueError(f"policy {kind!r} needs its value")
    return AnyOf(made[kind])


def decisions(steps: DataFrame, make: Callable[[], Policy], run: str = "run") -> DataFrame:
    """steps (run, place, step, steps, pass_ends, elapsed) with ``fires``.

    A policy with a Column stays in the plan; else each run is folded in the order of ``place``, a run a group.
    """
    predicate = make().column()
    if predicate is not None:
        return steps.withColumn("fires", predicate)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        policy, rows, fires = make(), rows.sort_values("place"), []
        for r in rows.itertuples():
            fires.append(policy.decide(Step(int(r.step), int(r.steps), bool(r.pass_ends), float(r.elapsed))))
        return rows.assign(fires=fires)

    return steps.groupBy(run).applyInPandas(fold, steps.withColumn("fires", F.lit(False)).schema)


def expected_checkpoints(segments: int, w: int, n: int, every_k: int | None, segment_end: bool = True) -> int:
    steps = w // n
    return segments * sum(1 for s in range(1, steps + 1) if (segment_end and s == steps) or (every_k and s % every_k == 0))


def expected_reports(segments: int, w: int, n: int, kind: str, every_k: int | None, every_step: bool = False) -> int:
    """Reports of a finished run: one for each checkpoint, and a last one if the last step isn't a checkpoint."""
    steps = w // n
    if every_step:
        return segments * steps
    k = every_k if kind in ("any", "every_k") else None
    at_end = kind in ("any", "segment_end", "pass_end")
    return expected_checkpoints(segments, w, n, k, at_end) + (0 if at_end or (k and steps % k == 0) else 1)


def fold(policy: Policy, steps: Iterator[Step]) -> Iterator[bool]:
    return map(policy.decide, steps)
