"""python -m tidelog.cli: inspect, export, log-ls, gc and resume-point of stores and runs."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from .operators.train import Checkpoints
from .plans.planner import replayed_positions, resume_start
from .session import builder
from .sources.log import BlockLog
from .sources.storage import Store


def _inspect(a) -> None:
    points = Checkpoints(Store.at(a.store), a.run, None)
    name = a.checkpoint or points.last()
    if name is None:
        raise FileNotFoundError(f"run {a.run} has no checkpoint")
    ledger = points.ledgers().get(name)
    if ledger is None:
        raise FileNotFoundError(f"no checkpoint {name}")
    kind, shards = points.shape(name)
    print(name, *(f"{k}={v}" for k, v in asdict(ledger).items()), f"{kind}/{shards}")


def _export(a) -> None:
    Checkpoints(Store.at(a.store), a.run, None).export(a.checkpoint, Store.at(a.target))


def _resume(a) -> None:
    ledger = Checkpoints(Store.at(a.store), a.run, None).ledgers()[a.checkpoint]
    w = BlockLog.open(Store.at(a.log or a.store)).W
    seq, step = resume_start(ledger.segment, ledger.cursor, ledger.world_size, a.workers, w)
    print(f"segment={seq} step={step} replayed={replayed_positions(ledger.cursor, ledger.world_size, a.workers)}")


def _ls(a) -> None:
    log = BlockLog.open(Store.at(a.store))
    print(f"W={log.W} seed={log.seed} segments={len(log.seqs())} ended={log.ended()}")
    for seq in log.seqs():
        s = log.read_segment(seq)
        print(f"{seq:08d} pass={s.pass_idx} rows={sum(b.num_rows for b in s.blocks)}" + (" " + " ".join(b.block_id for b in s.blocks) if a.verbose else ""))


def _gc(a) -> None:
    spark = builder("tidelog-gc").getOrCreate()
    print("deleted", *BlockLog.open(Store.at(a.store)).gc(spark, a.keep_from, not a.keep_blocks))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidelog")
    sub = top.add_subparsers(required=True)

    def command(name, fn, *args):
        p = sub.add_parser(name)
        p.set_defaults(fn=fn)
        p.add_argument("store")
        for names, kw in args:
            p.add_argument(*names, **kw)

    command("inspect", _inspect, (["run"], {}), (["--checkpoint"], {}))
    command("export", _export, (["run"], {}), (["checkpoint"], {}), (["target"], {}))
    command("resume", _resume, (["run"], {}), (["checkpoint"], {}), (["--workers"], {"type": int, "default": 1}), (["--log"], {}))
    command("log-ls", _ls, (["-v", "--verbose"], {"action": "store_true"}))
    command("gc", _gc, (["--keep-from"], {"type": int, "required": True}), (["--keep-blocks"], {"action": "store_true"}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.fn(args)
    except (OSError, ValueError, KeyError, RuntimeError) as e:
        print(f"tidelog: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
