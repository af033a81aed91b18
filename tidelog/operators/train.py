"""Training over a log: per-block user functions, replica agreement, ledgers and checkpoints.

A rank is a group of a Spark stage. Replicas that agree once a segment (local SGD, DiLoCo, none) fold their whole lane of the
segment in one task, block after block; replicas that agree on every step (ddp) give a gradient for each step, and a
step is one small job. Parameters are numpy arrays and few; they travel with the closure.
"""

from __future__ import annotations

import io
import itertools
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import checkpoint_name
from ..plans import planner
from ..plans.policy import Policy, SegmentEnd, Step, build_policy
from ..sources import blocks as B
from ..sources.audit import AuditWriter, next_attempt
from ..sources.loader import Loader
from ..sources.log import BlockLog
from ..sources.storage import Store
from .hooks import run_hooks

Params = list[np.ndarray]


@dataclass(frozen=True)
class Ledger:
    segment: int = 0
    cursor: int = 0
    world_size: int = 1
    pass_idx: int = 0
    run_attempt: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Ledger":
        d = json.loads(text)
        return Ledger(**{k: int(d[k]) for k in Ledger.__dataclass_fields__ if k in d})

    def name(self) -> str:
        return checkpoint_name(self.segment, self.cursor, self.world_size, self.run_attempt)


# ---- agreement ----


def average(replicas: list[Params]) -> Params:
    return [np.mean(x, axis=0) for x in zip(*replicas)]


def packed(arrays: Params) -> bytes:
    """Arrays as a file that holds nothing else: reading it runs no code."""
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def unpacked(data: bytes) -> Params:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return [found[f"arr_{i}"] for i in range(len(found.files))]


class LocalSGD:
    """Replicas take the mean of their parameters at each segment's end."""

    def reset(self, params: Params) -> None:
        """Begin anew from parameters whose checkpoint has no state of this kind."""

    def agree(self, replicas: list[Params]) -> Params:
        return average(replicas)

    def state(self) -> dict:
        return {}

    def restore(self, state: dict) -> None:
        pass


@dataclass
class DiLoCo:
    """The mean change since the last agreement is the gradient of an outer SGD with momentum over the anchor."""

    anchor: Params
    lr: float = 0.7
    momentum: float = 0.9
    nesterov: bool = True
    velocity: Params | None = None

    def __post_init__(self):
        if self.lr <= 0:
            raise ValueError("the outer rate must be positive")
        if not 0 <= self.momentum < 1:
            raise ValueError("the outer momentum must be at least 0 and below 1")

    def agree(self, replicas: list[Params]) -> Params:
        change = [a - m for a, m in zip(self.anchor, average(replicas))]
        self.velocity = change if self.velocity is None else [self.momentum * v + g for v, g in zip(self.velocity, change)]
        look = [g + self.momentum * v for g, v in zip(change, self.velocity)] if self.nesterov and self.momentum else self.velocity
        self.anchor = [a - self.lr * d for a, d in zip(self.anchor, look)]
        return [a.copy() for a in self.anchor]

    def reset(self, params: Params) -> None:
        self.anchor, self.velocity = [p.copy() for p in params], None

    def state(self) -> dict:
        return {"anchor": self.anchor} | ({} if self.velocity is None else {"velocity": self.velocity})

    def restore(self, state: dict) -> None:
        self.anchor, self.velocity = state["anchor"], state.get("velocity")


def build_sync(kind: str, params: Params, lr: float = 0.7, momentum: float = 0.9, nesterov: bool = True):
    made = {"ddp": lambda: None, "none": lambda: None, "local_sgd": LocalSGD, "diloco": lambda: DiLoCo([p.copy() for p in params], lr, momentum, nesterov)}
    if kind not in made:
        raise ValueError(f"unknown agreement {kind!r} (sharded parameters have no form here)")
    return made[kind]()


# ---- user functions ----


@dataclass(frozen=True)
class Info:
    rank: int
    world_size: int
    segment: int
    step: int
    position: int
    seed: int

    def generator(self) -> np.random.Generator:
        """Depends on the seed and position only, so a replay draws the same."""
        return np.random.default_rng((self.seed * 1_000_003 + self.position) % (1 << 63))


#: gradient(params, block as an Arrow table, info) -> (gradients, metrics)
Gradient = Callable[[Params, pa.Table, Info], tuple[Params, dict[str, float]]]


def linear_gradient(params: Params, table: pa.Table, info: Info) -> tuple[Params, dict[str, float]]:
    """Mean squared error of y against x_0 .. x_{d-1}."""
    names = sorted((c for c in table.column_names if c.startswith("x_")), key=lambda c: int(c[2:]))
    x = np.stack([table.column(c).to_numpy() for c in names], axis=1).astype(np.float64)
    y = table.column("y").to_numpy().astype(np.float64)
    off = x @ params[0] - y
    return [2 * x.T @ off / len(y)], {"loss": float(np.mean(off**2))}


class Metrics:
    """Last values and means over the steps since the last report; keys that a step lacks count as zero in its mean."""

    def __init__(self):
        self.last, self.sums, self.steps = {}, {}, 0

    def add(self, values: dict[str, Any]) -> None:
        self.steps += 1
        for k, v in values.items():
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                self.last[k] = float(v)
                self.sums[k] = self.sums.get(k, 0.0) + float(v)

    def flush(self) -> dict[str, float]:
        out = {**self.last, **{f"{k}_mean": v / max(1, self.steps) for k, v in self.sums.items()}, "steps_in_report": self.steps}
        self.__init__()
        return out


# ---- checkpoints ----


class Checkpoints:
    """Directories under a run: parameters and agreement state, ``ledger.json`` and ``.metadata.json``, the last written last."""

    def __init__(self, store: Store, run: str, keep: int | None = 3):
        self.store, self.run, self.keep = store, run, keep

    def save(self, ledger: Ledger, params: list[Params], sync_state: dict) -> str:
        name = ledger.name()
        shards = {"model.npz": params[0]} if len(params) == 1 else {f"shard-{i:05d}-of-{len(params):05d}.npz": p for i, p in enumerate(params)}
        for file, value in (shards | {f"sync-{k}.npz": v for k, v in sync_state.items()}).items():
            self.store.write(f"{self.run}/{name}/{file}", packed(value))
        self.store.write(f"{self.run}/{name}/ledger.json", ledger.to_json().encode())
        self.store.write(f"{self.run}/{name}/.metadata.json", json.dumps({"ledger": asdict(ledger), "tidelog": "1"}).encode())
        for old in self.names()[: -self.keep] if self.keep else []:
            for file in self.store.names(f"{self.run}/{old}"):
                self.store.delete(f"{self.run}/{old}/{file}")
        return name

    def names(self) -> list[str]:
        return list(self.ledgers())

    def read_ledger(self, name: str) -> Ledger:
        """From the metadata, else from the ledger's own file; parameters are never read."""
        try:
            return Ledger(**json.loads(self.store.read(f"{self.run}/{name}/.metadata.json"))["ledger"])
        except (OSError, ValueError, KeyError, TypeError):
            return Ledger.from_json(self.store.read(f"{self.run}/{name}/ledger.json").decode())

    def ledgers(self) -> dict[str, Ledger]:
        """By attempt and place; directories without a ledger that can be read are passed over."""
        out = {}
        for name in self.store.folders(self.run):
            try:
                out |= {name: self.read_ledger(name)} if name.startswith("checkpoint_") else {}
            except (OSError, ValueError, KeyError, TypeError):
                continue
        return dict(sorted(out.items(), key=lambda x: (x[1].run_attempt, x[1].segment, x[1].cursor * x[1].world_size)))

    def shape(self, name: str) -> tuple[str, int]:
        files = self.store.names(f"{self.run}/{name}")
        if "model.npz" in files:
            return "full", 1
        shards = [f for f in files if f.startswith("shard-")]
        if not shards:
            raise FileNotFoundError(f"{name} holds no parameters")
        total = int(shards[0].split("-of-")[1].split(".")[0])
        if len(shards) != total:
            raise FileNotFoundError(f"{name} has {len(shards)} of {total} shards")
        return "sharded", total

    def load(self, name: str) -> tuple[Ledger, list[Params], dict]:
        kind, n = self.shape(name)
        read = lambda f: unpacked(self.store.read(f"{self.run}/{name}/{f}"))
        params = [read("model.npz")] if kind == "full" else [read(f"shard-{i:05d}-of-{n:05d}.npz") for i in range(n)]
        sync = {f[5:-4]: read(f) for f in self.store.names(f"{self.run}/{name}") if f.startswith("sync-")}
        return self.read_ledger(name), params, sync

    def last(self) -> str | None:
        return next(reversed(self.names()), None)

    def middle(self) -> str | None:
        """The checkpoint in the middle of the run's, as restores of an older state want."""
        return self.names()[len(self.names()) // 2] if self.names() else None

    def export(self, name: str, target: Store) -> None:
        for file in self.store.names(f"{self.run}/{name}"):
            target.write(file, self.store.read(f"{self.run}/{name}/{file}"))


# ---- the loop ----


@dataclass
class BlockTrainer:
    spark: SparkSession
    log: BlockLog
    params: Params
    gradient: Gradient = linear_gradient
    n: int = 2
    lr: float = 0.05
    kind: str = "ddp"
    sync: Any = None
    policy: Policy = field(default_factory=SegmentEnd)
    runs: Store | None = None
    run: str = "run"
    hooks: tuple = ()
    retention: int | None = None
    keep: int | None = 3
    on_report: Callable[[dict], None] | None = None
    stop_after: int | None = None  # steps, as tests use to stop a run
    prefetch: int = 2  # blocks that a rank reads ahead, and its threads for them
    threads: int = 2

    def fit(self) -> tuple[Ledger, list[dict]]:
        """Read the log from the last checkpoint to its end; the ledger and the reports. The trail of an attempt that fails is kept."""
        trails: list[AuditWriter] = []
        try:
            return self._fit(trails)
        finally:
            for t in trails:
                t.close()

    def fit_again(self, max_failures: int = 3, workers: Callable[[], int] | None = None) -> tuple[Ledger, list[dict]]:
        """fit, tried again from the last checkpoint after a failure, so many times. workers: the world size of each attempt, as ranks come and go."""
        for failures in itertools.count():
            if workers is not None:
                self.n = workers()
            try:
                return self.fit()
            except Exception:
                if failures >= max_failures:
                    raise

    def _fit(self, trails: list[AuditWriter]) -> tuple[Ledger, list[dict]]:
        planner.steps_per_segment(self.log.W, self.n)
        store = self.runs or self.log.store
        points = Checkpoints(store, self.run, self.keep)
        attempt = next_attempt(store, self.run)
        replicas = [[p.copy() for p in self.params] for _ in range(self.n if self.kind == "none" else 1)]
        seq, step = self.log.first_seq() or 0, 0
        last = points.last()
        if last is not None:
            ledger, saved, state = points.load(last)
            replicas = [saved[i % len(saved)] for i in range(len(replicas))]
            if self.sync is not None:
                self.sync.restore(state) if state or not self.sync.state() else self.sync.reset(replicas[0])
            seq, step = planner.resume_start(ledger.segment, ledger.cursor, ledger.world_size, self.n, self.log.W)
            run_hooks(self.hooks, self.log, ledger.segment, replicas[0], replay=True) if ledger.cursor * ledger.world_size == self.log.W else None
        ledger = Ledger(seq, step, self.n, 0, attempt)
        trails += [AuditWriter(store, self.run, attempt, r) for r in range(self.n)]
        metrics, reports, began, done, saved_at = Metrics(), [], time.monotonic(), 0, None
        steps = self.log.W // self.n
        while True:
            segment = self.log.wait_segment(seq, poll_s=0.1)
            if segment is None:
                break
            if seq < (self.log.first_seq() or 0):
                raise RuntimeError(f"segment {seq} has been collected")
            every_step = self.kind == "ddp"
            spans = [(s, s + 1) for s in range(step, steps)] if every_step else [(step, steps)]
            for low, high in spans:
                replicas, rows = self._advance(segment, low, high, replicas)
                for r in rows:
                    trails[r["rank"]].append({"attempt": attempt, "world_size": self.n, "segment": seq, **{k: r[k] for k in ("rank", "step", "position", "block_id")}, "ts": time.time()})
                for s in range(low, high):
                    metrics.add(next((json.loads(r["metrics"]) for r in rows if r["step"] == s and r["rank"] == 0), {}))
                if high == steps and self.sync is not None:
                    replicas = [self.sync.agree(replicas)]
                for s in range(low + 1, high + 1):  # a folded span can only be saved at its end
                    done += 1
                    fires = self.policy.decide(Step(s, steps, s == steps and self.log.next_pass_differs(segment), time.monotonic() - began))
                    ledger = Ledger(seq, s, self.n, segment.pass_idx, attempt)
                    if fires and s == high:
                        for t in trails:  # what a checkpoint covers is on record before it
                            t.flush()
                        saved_at = points.save(ledger, replicas, self.sync.state() if self.sync else {})
                        self.policy.checkpointed(Step(s, steps, False, time.monotonic() - began))
                        reports.append({"checkpoint": saved_at, **metrics.flush()})
                        if self.on_report:
                            self.on_report(reports[-1])
                if self.stop_after is not None and done >= self.stop_after:
                    self.params = replicas[0]
                    return ledger, reports
            run_hooks(self.hooks, self.log, seq, replicas[0])
            if self.retention is not None and saved_at is not None:
                self.log.gc(self.spark, points.ledgers()[saved_at].segment - self.retention)
            seq, step = seq + 1, 0
        if metrics.steps:
            reports.append({"checkpoint": None, **metrics.flush()})
        self.params, self.replicas = replicas[0], replicas
        return ledger, reports

    def _advance(self, segment, low: int, high: int, replicas: list[Params]) -> tuple[list[Params], list[dict]]:
        """Steps low to high of a segment on all ranks; the new replicas and a row for each block."""
        n, gradient, lr, seed, ddp, ahead, threads = self.n, self.gradient, self.lr, self.log.seed, self.kind == "ddp", self.prefetch, self.threads
        plan = [(p % n, p // n, segment.seq * segment.W + p, b.block_id, b.locator) for p, b in enumerate(segment.blocks) if low <= p // n < high]
        rows = self.spark.createDataFrame(plan, "rank long, step long, position long, block_id string, locator string")
        store, seq = self.log.store, segment.seq
        sent = self.spark.sparkContext.broadcast([packed(p) for p in replicas])
        schema = "rank long, step long, position long, block_id string, metrics string, result binary"

        def lane(key: tuple, table: pa.Table) -> pa.Table:
            rank = key[0].as_py()
            params, grads = unpacked(sent.value[rank % len(sent.value)]), []
            out: list[dict] = []
            items = sorted(table.to_pylist(), key=lambda r: r["step"])
            for r, block in Loader(lambda r: B.load_block(store, r["locator"]), items, ahead, threads):
                grads, values = gradient(params, block, Info(rank, n, seq, r["step"], r["position"], seed))
                if not ddp:
                    params = [p - lr * g for p, g in zip(params, grads)]
                out.append({k: r[k] for k in ("rank", "step", "position", "block_id")} | {"metrics": json.dumps(values), "result": None})
            out[-1]["result"] = packed(grads if ddp else params)
            types = {"rank": pa.int64(), "step": pa.int64(), "position": pa.int64(), "block_id": pa.string(), "metrics": pa.string(), "result": pa.binary()}
            return pa.table({k: pa.array([x[k] for x in out], t) for k, t in types.items()})

        found = rows.groupBy("rank").applyInArrow(lane, schema).collect()  # W rows
        sent.destroy()
        found = sorted((r.asDict() for r in found), key=lambda r: (r["rank"], r["step"]))
        results = [unpacked(r["result"]) for r in found if r["result"] is not None]
        if ddp:
            return [[p - lr * g for p, g in zip(replicas[0], average(results))]], found
        return results, found


def worker_count(available: int, w: int, low: int, high: int) -> int:
    """The most ranks in a range that there are places for; the log's W has been checked against the whole range."""
    n = min(high, available)
    if n < low:
        raise RuntimeError(f"{available} workers are available, {low} are needed")
    return max(k for k in range(low, n + 1) if w % k == 0)


def trainer_of(spark: SparkSession, config, params: Params, gradient: Gradient = linear_gradient, **more) -> BlockTrainer:
    """A trainer as a Config says: log, ranks, agreement, policy, hooks, retention and reading ahead. fit_again(config.failure.max_failures) runs it."""
    from .hooks import build_hooks

    ck, par = config.checkpoint, config.parallel
    log = BlockLog.open(Store.at(config.store_root, config.storage.access()))
    low, high = config.scaling.bounds()
    sync = build_sync(par.kind, params, par.outer_lr, par.outer_momentum, par.outer_nesterov)
    return BlockTrainer(
        spark, log, params, gradient, n=worker_count(spark.sparkContext.defaultParallelism, log.W, low, high), lr=float(config.train.get("lr", 0.05)), kind=par.kind, sync=sync,
        policy=build_policy(ck.policy, ck.every_k, ck.time_budget_s, ck.time_poll_every), runs=Store.at(config.storage_path, config.storage.access()), run=config.run_name,
        hooks=tuple(build_hooks(config)), retention=config.log.retention_segments if config.log.gc else None, keep=ck.num_to_keep, prefetch=config.loader.prefetch, threads=config.loader.threads, **more,
    )


def map_blocks(rows: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str, by: str = "block_id") -> DataFrame:
    """A user function over each block's rows, as Arrow tables."""

    def one(table: pa.Table) -> pa.Table:
        return fn(table)

    return rows.groupBy(by).applyInArrow(one, schema)


def metric_windows(steps: DataFrame) -> DataFrame:
    """steps (run, step, value or null, report): for each report window the last value, the mean over all its steps, their number."""
    from pyspark.sql import Window as W

    before = W.partitionBy("run").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    rows = steps.withColumn("window", F.coalesce(F.sum(F.col("report").cast("long")).over(before), F.lit(0)).cast("long"))
    return rows.groupBy("run", "window").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("step"))).alias("last_value"), (F.sum("value") / F.count("*")).alias("value_mean"), F.count("*").alias("steps_in_report")
    )


def linear_sums(rows: DataFrame, by: list[str], x: list[str], y: str, weights: list[float]) -> DataFrame:
    """Loss and gradient of a linear model for each group, as one aggregation."""
    off = sum((F.col(c) * w for c, w in zip(x, weights)), F.lit(0.0)) - F.col(y)
    return rows.withColumn("_off", off).groupBy(*by).agg(F.avg(F.col("_off") * F.col("_off")).alias("loss"), *[(2 * F.avg(F.col("_off") * F.col(c))).alias(f"grad_{i}") for i, c in enumerate(x)])


def with_world_size(ledger: Ledger, n: int, w: int) -> Ledger:
    """The ledger that n ranks begin with."""
    seq, step = planner.resume_start(ledger.segment, ledger.cursor, ledger.world_size, n, w)
    return replace(ledger, segment=seq, cursor=step, world_size=n)
