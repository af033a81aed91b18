"""A paced producer: generated blocks are pushed through a StreamingWriter until so many segments are committed."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..sources.blocks import write_table
from ..sources.log import BlockLog, Ref, Segment
from ..sources.storage import Store
from .writer import StreamingWriter


def regression_rows(rows: int, dim: int, seed: int, weights: np.ndarray | None = None) -> pa.Table:
    """x_0 .. x_{d-1} and y = x . w + noise, single precision."""
    g = np.random.default_rng(seed)
    w = np.arange(1, dim + 1, dtype=np.float64) / dim if weights is None else weights
    x = g.normal(size=(rows, dim))
    y = x @ w + 0.05 * g.normal(size=rows)
    return pa.table({**{f"x_{i}": x[:, i].astype(np.float32) for i in range(dim)}, "y": y.astype(np.float32)})


def gaussian_corpus(items: int, dim: int, clusters: int, seed: int, spread: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, cluster of each) around random centres."""
    g = np.random.default_rng(seed)
    centres, cluster = g.normal(size=(clusters, dim)), np.arange(items) % clusters
    return (centres[cluster] + spread * g.normal(size=(items, dim))).astype(np.float32), cluster


def produce(store: Store, segments: int, W: int = 4, seed: int = 7, k: int = 1, rows: int = 4, dim: int = 4, sleep_s: float = 0.0, progress: Callable[[Segment], None] | None = None) -> BlockLog:
    log = BlockLog.create(store, W, seed, "produce")  # refuses a store that has a log
    writer, number = StreamingWriter(log, k), 0
    while len(writer.committed) < segments:
        block = f"p{number:06d}"
        ref = Ref(*write_table(store, block, regression_rows(rows, dim, seed + number)), {"produced_at": time.time()})
        done = writer.push(ref)
        number += 1
        if done is not None:
            if progress:
                progress(done)
            time.sleep(sleep_s)
    log.end()
    return log
