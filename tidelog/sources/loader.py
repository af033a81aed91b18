"""Blocks read ahead: items come from an iterator that may wait (a live log), tables from a few threads, in the items' order."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any


class Loader:
    """Iterate (item, read(item)). At most ``prefetch`` items are ahead of the consumer; what fails is raised where its item stands.

    items: an iterable, or a function of an event that is set when the loader is closed, so that a waiting iterator can stop. A loader
    is iterated once; closing it, from any thread, ends the iteration, drops what was read ahead and lets the threads go.
    """

    def __init__(self, read: Callable[[Any], Any], items: Iterable | Callable[[threading.Event], Iterable], prefetch: int = 2, threads: int = 2):
        if prefetch <= 0 or threads <= 0:
            raise ValueError("prefetch and threads must be positive")
        self.read, self.stopped = read, threading.Event()
        self.items = items(self.stopped) if callable(items) else items
        self.room, self.ready = threading.Semaphore(prefetch), queue.SimpleQueue()
        self.pool = ThreadPoolExecutor(threads + 1, "loader")  # one walks the items
        self.begun = False

    def _walk(self) -> None:
        last: Any = None
        try:
            for item in self.items:
                self.room.acquire()
                if self.stopped.is_set():
                    break
                self.ready.put((item, self.pool.submit(self.read, item)))
        except BaseException as e:  # raised at the consumer
            last = e
        finally:
            if hasattr(self.items, "close"):
                self.items.close()
            self.ready.put(last)

    def __iter__(self) -> Iterator[tuple[Any, Any]]:
        if self.begun or self.stopped.is_set():
            raise RuntimeError("a loader is iterated once")
        self.begun = True
        self.pool.submit(self._walk)
        try:
            while (got := self.ready.get()) is not None and not self.stopped.is_set():
                if isinstance(got, BaseException):
                    raise got
                item, table = got
                self.room.release()
                yield item, table.result()
        finally:
            self.close()

    def close(self) -> None:
        if self.stopped.is_set():
            return
        self.stopped.set()
        self.room.release()  # the walker, if it waits for room
        self.ready.put(None)  # the consumer, if it waits for an item
        while not self.ready.empty():
            got = self.ready.get()
            if isinstance(got, tuple) and isinstance(got[1], Future):
                got[1].cancel()
        self.ready.put(None)
        self.pool.shutdown(wait=False, cancel_futures=True)
