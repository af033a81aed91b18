import threading

import pytest
from pyspark.errors import StreamingQueryException

from tidelog.sources.datasource import ManifestStream
from tidelog.sources.log import BlockLog, Ref
from tidelog.sources.storage import Store
from tidelog.streaming.consume import consume_committed, drain, stretches
from tidelog.streaming.produce import produce
from tidelog.streaming.writer import Mixer, StreamingWriter, segments_of


def refs(n, low=0):
    return [Ref(f"b{i:03d}", f"blocks/b{i:03d}.parquet", 1) for i in range(low, n)]


def test_buffer_and_close(tmp_path):
    log = BlockLog.create(Store.at(str(tmp_path)), 4, 7)
    w = StreamingWriter(log, 2)
    done = [w.push(r) for r in refs(12)]
    assert sum(x is not None for x in done) == 2 and w.buffered == 4
    with pytest.raises(ValueError):
        w.push(refs(1)[0])
    assert len(w.close()) == 1 and log.ended()
    assert sorted(b.block_id for s in w.committed for b in s.blocks) == [r.block_id for r in refs(12)]


def test_tails(tmp_path):
    for tail, n in (("drop", 1), ("wrap", 2)):
        w = StreamingWriter(BlockLog.create(Store.at(str(tmp_path / tail)), 4, 7))
        for r in refs(6):
            w.push(r)
        w.close(tail)
        assert len(w.committed) == n and (n == 1 or w.committed[-1].meta["wrapped"])
    w = StreamingWriter(BlockLog.create(Store.at(str(tmp_path / "e")), 4, 7))
    for r in refs(5):
        w.push(r)
    with pytest.raises(ValueError):
        w.flush("error")
    w = StreamingWriter(BlockLog.create(Store.at(str(tmp_path / "f")), 4, 7))
    w.push(refs(1)[0])
    with pytest.raises(ValueError):
        w.flush("wrap")
    with pytest.raises(ValueError):
        StreamingWriter(w.log, 0)


def test_mixer_goes_on_from_its_state():
    names = [f"b{i}" for i in range(40)]
    whole, parts, m = list(Mixer(4, 2, 7).feed(names)), [], Mixer(4, 2, 7)
    for name in names:
        parts += m.feed([name])
        state = m.state()
        m = Mixer(4, 2, 7)
        m.restore(state)
    assert whole == parts and len(whole) == 9 and m.draws == 9
    with pytest.raises(ValueError):
        list(m.feed([m.waiting[0]]))


def test_stateful_query_equals_the_writer(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        spark.range(k * 20, k * 20 + 20).selectExpr("id as arrival", "format_string('b%03d', id) as block_id").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("arrival long, block_id string").option("maxFilesPerTrigger", 1).parquet(str(source))
    segments_of(stream, 4, 2, 7).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.seq, {})[r.slot] = r.block_id
    ids = list(Mixer(4, 2, 7).feed(f"b{i:03d}" for i in range(60)))
    assert sorted(x for s in got.values() for x in s.values()) == sorted(x for s in ids for x in s)
    assert all(sorted(s) == [0, 1, 2, 3] for s in got.values())


def test_live_producer_and_consumer_with_retention(spark, tmp_path):
    store = Store.at(str(tmp_path / "s"))
    made = []
    log_ready = threading.Event()
    thread = threading.Thread(target=lambda: produce(store, 5, W=4, k=2, sleep_s=0.1, progress=lambda s: (made.append(s.seq), log_ready.set())))
    thread.start()
    log_ready.wait(20)
    seen = []
    drain(spark, BlockLog.open(store), 2, lambda rows, seq: seen.append((seq, rows.count())), checkpoint=str(tmp_path / "c"), retention=2)
    thread.join()
    assert made == [0, 1, 2, 3, 4] and [s for s, _ in seen] == made and all(n == 4 for _, n in seen)
    assert BlockLog.open(store).seqs() == [2, 3, 4]
    with pytest.raises(FileExistsError):
        produce(store, 1)


def a_log(path, n, w=2):
    log = BlockLog.create(Store.at(str(path)), w, 7)
    for low in range(0, n * w, w):
        log.append(refs(low + w, low))
    log.end()
    return log


def test_a_bounded_trigger_asks_for_its_own_segments_only(tmp_path, monkeypatch):
    log = a_log(tmp_path, 7)
    stream = ManifestStream(log.store.uri, 2, 0, 5)
    assert stream.latestOffset() == {"seq": 2}
    monkeypatch.setattr(BlockLog, "seqs", lambda self: pytest.fail("the log was listed"))
    assert [stream.latestOffset()["seq"] for _ in range(3)] == [4, 5, 5]
    parts = stream.partitions({"seq": 0}, {"seq": 150})
    assert [s for p in parts for s in p.seqs] == list(range(150)) and len(parts) == 3


def test_an_end_bounds_a_stream_without_batch_size_and_gaps_stop_it(tmp_path):
    log = a_log(tmp_path, 7)
    assert ManifestStream(log.store.uri, None, None).latestOffset() == {"seq": 7}
    assert ManifestStream(log.store.uri, None, 2, 6).latestOffset() == {"seq": 6}
    log.store.delete("log/00000003.json")
    assert ManifestStream(log.store.uri, None, 0, 6).latestOffset() == {"seq": 3}
    assert ManifestStream(log.store.uri, 2, 2).latestOffset() == {"seq": 3}


def test_stretches_are_whole_triggers_and_leave_nothing_out():
    for first in (0, 5):
        for n in (1, 2, 15, 31, 32, 33, 64, 125, 200, 7501):
            for per in (1, 2, 3):
                found = stretches(first, first + n, per, 6)
                assert [s for low, high in found for s in range(low, high)] == list(range(first, first + n)) and len(found) <= 6
                assert all((high - low) % per == 0 for low, high in found[:-1])
    assert stretches(0, 12, 2, 6) == [(0, 12)] and len(stretches(0, 7500, 2, 6)) == 6


def test_a_long_log_is_read_by_several_streams(spark, tmp_path):
    log, seen = a_log(tmp_path / "s", 67), {}
    checkpoint = f"file://{tmp_path}/c"
    consume_committed(spark, log, 2, lambda rows, k: seen.setdefault(k, []).append(sorted({r.seq for r in rows.collect()})), checkpoint=checkpoint)
    assert len(seen) == 2
    assert [found for k in sorted(seen) for found in seen[k]] == [[s for s in (low, low + 1) if s < 67] for low in range(0, 67, 2)]
    assert spark.conf.get("spark.sql.streaming.checkpointFileManagerClass", None) is None
    assert len(list((tmp_path / "c" / "000" / "offsets").glob("[0-9]*"))) == len(seen[0])
    seen.clear()
    log.store.delete("log/00000003.json")  # what is behind a gap isn't read, in whatever stretch it would be
    consume_committed(spark, log, 2, lambda rows, k: seen.setdefault(k, []).append(sorted({r.seq for r in rows.collect()})), checkpoint=f"file://{tmp_path}/d")
    assert seen == {0: [[0, 1], [2]]}


def test_an_error_of_one_stretch_ends_all(spark, tmp_path):
    log = a_log(tmp_path / "s", 67)

    def fail(rows, k):
        if k == 1:
            raise ValueError("no")

    with pytest.raises(StreamingQueryException):
        consume_committed(spark, log, 2, fail, checkpoint=f"file://{tmp_path}/c")
    assert not spark.streams.active
