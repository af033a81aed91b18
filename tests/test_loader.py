import threading
import time

import pytest

from tidelog.sources.loader import Loader


def test_order_and_bound():
    """Slow and quick reads come in the items' order; no more than prefetch are ahead of the consumer."""
    begun, lock = [], threading.Lock()

    def read(i):
        with lock:
            begun.append(i)
        time.sleep(0.02 if i % 2 else 0.0)
        return 10 * i

    got = []
    for item, value in Loader(read, range(20), prefetch=3, threads=2):
        got.append((item, value))
        time.sleep(0.01)
        assert len(begun) <= len(got) + 4
    assert got == [(i, 10 * i) for i in range(20)]
    assert list(Loader(read, [])) == []


def test_errors_are_raised_where_their_item_stands():
    def read(i):
        if i == 3:
            raise OSError("missing")
        return i

    loader, got = Loader(read, range(9)), []
    with pytest.raises(OSError, match="missing"):
        for item, _ in loader:
            got.append(item)
    assert got == [0, 1, 2]

    def lanes():
        yield 1
        raise RuntimeError("gap")

    with pytest.raises(RuntimeError, match="gap"):
        list(Loader(lambda x: x, lanes()))


def test_close_ends_a_waiting_iteration():
    """Items come from a function of the stop event, as a live log's do; closing from another thread lets all go."""
    ended = threading.Event()

    def items(stop):
        try:
            yield 0
            while not stop.wait(0.01):
                pass
        finally:
            ended.set()

    loader = Loader(lambda x: x, items)
    threading.Timer(0.2, loader.close).start()
    assert [i for i, _ in loader] == [0]
    assert ended.wait(2)
    with pytest.raises(RuntimeError):
        iter(loader).__next__()
    loader.close()


def test_what_is_ready_is_given_while_the_log_waits():
    go = threading.Event()

    def items(stop):
        yield 1
        go.wait(5)
        yield 2

    out = iter(Loader(lambda x: x, items))
    assert next(out)[0] == 1
    go.set()
    assert next(out)[0] == 2
    out.close()


def test_bad_sizes():
    for bad in ({"prefetch": 0}, {"threads": 0}):
        with pytest.raises(ValueError):
            Loader(lambda x: x, [], **bad)
