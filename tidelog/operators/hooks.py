"""Segment-end hooks: parsed, loaded and called in configured order, at least once."""

from __future__ import annotations

import importlib
import re
from typing import Any


def hook_specs(hooks: dict[str, Any] | None) -> list[tuple[str, str, dict]]:
    """(name, ``pkg.module:attr``, arguments); a value is the entry, or a map with ``entry`` and arguments."""
    out = []
    for name, value in (hooks or {}).items():
        args = dict(value) if isinstance(value, dict) else {"entry": value}
        entry = args.pop("entry", None)
        if not isinstance(entry, str) or not re.fullmatch(r"[A-Za-z_][\w.]*:[A-Za-z_]\w*", entry):
            raise ValueError(f"hook {name!r}: {entry!r} doesn't look like pkg.module:attr")
        out.append((name, entry, args))
    return out


def load_entry(entry: str) -> Any:
    module, _, attr = entry.partition(":")
    return getattr(importlib.import_module(module), attr)


def build_hooks(config: Any) -> list[Any]:
    return [load_entry(entry)(config, **args) for _, entry, args in hook_specs(config.hooks)]


def run_hooks(hooks, log, seq: int, context: Any = None, replay: bool = False) -> None:
    """Call each hook after a segment. On a restart (replay) only if the log hasn't ended and lacks the next segment."""
    if replay and (log.ended() or log.has_segment(seq + 1)):
        return
    for hook in hooks:
        (hook.on_segment_end if hasattr(hook, "on_segment_end") else hook)(log, seq, context)


class RemineHook:
    """Mine the next segment from the corpus as the given model sees it.

    items: (item, cluster, vector) as numpy arrays on the driver (a training toy's corpus); embed(model, vectors) gives the
    space in which neighbours are looked for. Ids carry segment and attempt, so a replay never meets old files.
    """

    def __init__(self, spark, items, embed, batch: int, k: int, segments: int, seed: int = 7, attempt: int = 0):
        self.spark, self.items, self.embed, self.batch, self.k, self.segments, self.seed, self.attempt = spark, items, embed, batch, k, segments, seed, attempt

    def on_segment_end(self, log, seq: int, model: Any = None) -> None:
        if log.ended() or log.has_segment(seq + 1):
            return
        if seq + 1 >= self.segments:
            log.end()
            return
        self.mine(log, seq + 1, model, {"mined_after_segment": seq, "space": "embedding" if model is not None else "input"})

    def mine(self, log, seq: int, model: Any, meta: dict) -> None:
        from pyspark.sql import functions as F

        from ..plans.planner import segment_anchors
        from ..sources.blocks import write_blocks
        from ..sources.log import Ref
        from . import mining

        ids, cluster, vectors = self.items
        per_segment = log.W * self.batch
        if not len(ids) or len(ids) % per_segment:
            raise ValueError(f"{len(ids)} items are no multiple of W * batch = {per_segment}")
        if log._next is not None and seq != log._next:
            raise ValueError(f"segment {seq} isn't the next one")
        space = vectors if model is None else self.embed(model, vectors)
        rows = self.spark.createDataFrame([(int(i), int(c), [float(x) for x in v], [float(x) for x in s]) for i, c, v, s in zip(ids, cluster, vectors, space)], "vec_id long, label long, embedding array<float>, space array<double>")
        near = mining.near_clusters(mining.centroid_vectors(rows, vector="space"), self.k)
        training = mining.training_rows(rows, near, self.k, self.seed + seq)
        anchors = segment_anchors(rows.select("vec_id"), "vec_id", per_segment, seq + 1, self.seed, len(ids)).where(F.col("seq") == seq)
        name = F.concat(F.lit(f"s{seq:06d}a{self.attempt:02d}b"), F.lpad(F.floor(F.col("i") / self.batch).cast("string"), 5, "0"))
        out = training.join(anchors.select("item", name.alias("block_id")), "item")
        refs = sorted(tuple(r) for r in write_blocks(out.withColumnRenamed("item", "item_id"), log.store).collect())
        log.append([Ref(*r) for r in refs], 0, {"writer": "remine", **meta})


def remine_args(hooks: dict[str, Any] | None, name: str = "remine") -> dict | None:
    """The arguments of the configured re-mining hook; None if there is none."""
    return next((args for n, _, args in hook_specs(hooks) if n == name), None)


def initial_log(store, W: int, seed: int, hook: RemineHook, segments: int = 1):
    """A new log whose first segments are mined in input space; the log goes on, as the hook adds the others."""
    from ..sources.log import BlockLog

    if segments < 1:
        raise ValueError("a log begins with a segment at least")
    log = BlockLog.create(store, W, seed, "remine")
    for seq in range(segments):
        hook.mine(log, seq, None, {"space": "input"})
    return log


def ensure_blocks(store, make) -> Any:
    """The log of a store, made by make() if there is none: a second call changes nothing."""
    from ..sources.log import BlockLog

    return BlockLog.open(store) if store.exists("log/_meta.json") else make()


def reset_run(store, run: str) -> int:
    """Delete a run's trails and checkpoints, never its log and blocks; the number of files that went."""
    if not run or "/" in run or run in ("log", "blocks", "probe"):
        raise ValueError(f"{run!r} isn't the name of a run")
    names = [f"audit/{run}/{n}" for n in store.names(f"audit/{run}")]
    names += [f"{run}/{point}/{n}" for point in store.folders(run) for n in store.names(f"{run}/{point}")]
    for name in names:
        store.delete(name)
    return len(names)
