import json
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog import cli
from tidelog.config import Config, load, with_overrides
from tidelog.operators.writers import distinct_refs, write_batch
from tidelog.sources import audit, blocks
from tidelog.sources.datasource import register
from tidelog.sources.log import BlockLog, Ref
from tidelog.sources.storage import Store


@pytest.fixture
def store(tmp_path):
    return Store.at(str(tmp_path / "store"))


def make(store, n, rows=4):
    return [Ref(*blocks.write_table(store, f"b{i:04d}", pa.table({"x": [float(i * rows + k) for k in range(rows)]}))) for i in range(n)]


def test_append_rules(store, spark):
    log, refs = BlockLog.create(store, 4, 7), make(store, 12)
    with pytest.raises(FileExistsError):
        BlockLog.create(store, 4, 7)
    with pytest.raises(ValueError):
        log.append(refs[:3])
    stale = BlockLog.open(store)
    stale._next = 0
    first = log.append(refs[:4], spark=spark)
    assert first.seq == 0 and list(first.positions()) == [0, 1, 2, 3] and {b.block_id for b in first.blocks} == {r.block_id for r in refs[:4]}
    with pytest.raises(FileExistsError):
        stale.append(refs[4:8])
    store.write("blocks/b0005.parquet", b"broken")
    with pytest.raises(FileNotFoundError, match="b0005"):
        log.append(refs[4:8], spark=spark)
    log.append(refs[8:12], pass_idx=1)
    assert log.next_pass_differs(first) and not log.next_pass_differs(log.read_segment(1))
    log.end()
    log.end()
    assert log.next_pass_differs(log.read_segment(1))
    with pytest.raises(RuntimeError):
        log.append(refs[:4])
    with pytest.raises(FileNotFoundError):
        BlockLog.open(Store.at(store.uri + "x"))
    store.write("log/00000009.json.tmp-abc", b"{}")
    assert log.segments(spark).count() == 2 and log.manifest(spark).count() == 8
    assert json.loads(store.read("log/00000000.json"))["schema_version"] == 1


def test_gc(store, spark):
    log, refs = BlockLog.create(store, 2, 7), make(store, 6)
    log.append(refs[:2])
    log.append([refs[2], refs[0]])
    log.append(refs[4:])
    assert log.gc(spark, 0) == [] and log.gc(spark, 1) == [0] and store.exists("blocks/b0000.parquet") and not store.exists("blocks/b0001.parquet")
    assert log.segments(spark).where("seq >= 0").count() == 2 and log.contiguous(spark, 0).count() == 0 and log.contiguous(spark).count() == 2
    with pytest.raises(RuntimeError, match="collected"):
        log.lanes(spark, 0, 1, 0)
    assert log.gc(spark, 99) == [1, 2] and log.gc(spark, 99) == []


def test_hole_and_lanes(store, spark):
    log, refs = BlockLog.create(store, 4, 7), make(store, 12)
    for i in range(3):
        log.append(refs[4 * i : 4 * i + 4])
    assert [r.position for r in log.lanes(spark, 1, 2, 0, 1).orderBy("position").collect()] == [3, 5, 7, 9, 11]
    rows = log.rows(spark, 7).collect()
    assert len(rows) == 7 and [r.position for r in rows] == [0, 0, 0, 0, 1, 1, 1]
    store.delete("log/00000001.json")
    with pytest.raises(RuntimeError, match="missing"):
        log.lanes(spark, 0, 2, 0)


def test_wait(store):
    log, refs = BlockLog.create(store, 1, 7), make(store, 1)
    with pytest.raises(TimeoutError):
        log.wait_segment(0, 0.01, 0.05)
    assert log.wait_segment(0, 0.01, stop=lambda: True) is None
    threading.Thread(target=lambda: (time.sleep(0.2), log.append(refs), log.end())).start()
    assert log.wait_segment(0, 0.02, 5).seq == 0 and log.wait_segment(1, 0.02, 5) is None


def test_blocks(store, spark):
    df = spark.range(40).select((F.col("id") % 5).alias("k"), "id", F.format_string("b%02d", F.col("id") % 5).alias("block_id"))
    refs = blocks.write_blocks(df, store).collect()
    assert sorted((r.block_id, r.num_rows) for r in refs) == [(f"b{i:02d}", 8) for i in range(5)]
    assert blocks.read_block(spark, store, "blocks/b01.parquet").count() == 8
    assert blocks.constant_problems(spark.read.parquet(store.path("blocks"))).count() == 0
    with pytest.raises(ValueError):
        blocks.write_table(store, "b9", pa.table({"block_id": ["other"]}))
    blocks.write_table(store, "b8", pa.table({"block_id": pa.array([], pa.string())}))
    bad = spark.createDataFrame([("b01", "blocks/b01.parquet", 9), ("no", "blocks/no.parquet", 1)], blocks.REFS)
    with pytest.raises(FileNotFoundError):
        blocks.verify_blocks(bad, store)


def test_batch_writer(store, spark):
    log, refs = BlockLog.create(store, 4, 7), make(store, 10)
    with pytest.raises(ValueError):
        write_batch(log, refs + refs[:1])
    with pytest.raises(ValueError):
        write_batch(log, refs, 1, "error")
    with pytest.raises(ValueError):
        write_batch(log, refs[:3], 1, "drop")
    done = write_batch(log, refs, 2, "wrap", spark)
    assert [s.pass_idx for s in done] == [0, 0, 0, 1, 1, 1] and log.ended() and [r.block_id for r in distinct_refs(done)] == [r.block_id for r in refs]


def test_data_source(store, spark):
    log, refs = BlockLog.create(store, 2, 7), make(store, 8)
    register(spark)
    spark.createDataFrame([(r.block_id, r.locator, r.num_rows) for r in refs], blocks.REFS).selectExpr(
        "0L as seq", "0L as pass", "0L as pos", "0L as position", "block_id", "locator", "num_rows").write.format("tidelog").mode("append").option("path", store.uri).save()
    assert log.last_seq() == 3
    batch = spark.read.format("tidelog").option("path", store.uri).load()
    assert batch.count() == 8 and batch.where("seq >= 2 and seq < 3").count() == 2


def test_audit(store, spark):
    w = audit.AuditWriter(store, "r", 0, 1, part_lines=2)
    for k in range(5):
        w.append({"attempt": 0, "rank": 1, "world_size": 2, "segment": 0, "step": k, "position": 2 * k + 1, "block_id": f"b{k}", "ts": 9.0 - k})
    w.close()
    with pytest.raises(ValueError):
        w.append({})
    store.write("audit/r/notes.txt", b"x")
    store.write("audit/r/0-0.jsonl", b'\n{"attempt":0,"rank":0,"step":7}\n\n')
    got = audit.ordinals(audit.read_audit(spark, store, "r")).orderBy("rank", "ordinal").collect()
    assert [(r.rank, r.step) for r in got] == [(0, 7), *[(1, k) for k in range(5)]]  # file order, though clocks run backwards
    assert audit.next_attempt(store, "r") == 1 and audit.next_attempt(store, "none") == 0 and audit.read_audit(spark, store, "none").count() == 0


def test_storage(store, tmp_path):
    store.write("a/b.txt", b"1")
    assert store.read("a/b.txt") == b"1" and store.names("a") == ["b.txt"] and store.names("zz") == [] and store.folders() == ["a"]
    store.delete("a/none")
    with pytest.raises(FileNotFoundError):
        store.delete("a/none", missing_ok=False)
    with pytest.raises(ValueError):
        Store.at("ftp://x/y")


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("log: {W: 12}\nscaling: {num_workers: [1, 4]}\n")
    c = load(str(path), ["log.passes=3", "train.lr=0.1", "checkpoint.every_k=null"])
    assert (c.log.W, c.log.passes, c.train, c.checkpoint.every_k) == (12, 3, {"lr": 0.1}, None) and c.store_root.startswith("/")
    for bad in ({"log": {"X": 1}}, {"log": {"W": 10}, "scaling": {"num_workers": [1, 4]}}, {"log": {"gc": True, "retention_segments": 0}}, {"run_name": "a/b"}, {"hooks": {"h": "nocolon"}}, {"parallel": {"kind": "fsdp"}}):
        with pytest.raises(ValueError):
            Config.of(bad)
    with pytest.warns(UserWarning):
        Config.of({"parallel": {"kind": "local_sgd"}})
    with pytest.raises(ValueError):
        with_overrides({}, ["novalue"])


def test_cli(store, capsys):
    log, refs = BlockLog.create(store, 2, 7), make(store, 2)
    log.append(refs)
    assert cli.main(["log-ls", store.uri, "-v"]) == 0 and "b0001" in capsys.readouterr().out
    assert cli.main(["log-ls", store.uri + "x"]) == 1 and "no log" in capsys.readouterr().err
    assert cli.main(["inspect", store.uri, "run"]) == 1


def test_object_stores_have_two_names(monkeypatch):
    from tidelog.sources.storage import S3Access

    for name in ("S3_ENDPOINT", "S3_REGION", "S3_ACCESS_KEY", "S3_SECRET_KEY"):
        monkeypatch.delenv(name, raising=False)
    store = Store.at("s3a://bucket/a/")
    assert store == Store.at("s3://bucket/a") and (store.uri, store.path("x")) == ("s3://bucket/a", "s3a://bucket/a/x") and store.s3 == S3Access()
    monkeypatch.setenv("S3_ENDPOINT", "http://host:9000")
    monkeypatch.setenv("S3_ACCESS_KEY", "k")
    monkeypatch.setenv("S3_SECRET_KEY", "s")
    found = Store.at("s3://bucket/a").s3
    assert found.for_arrow() == {"access_key": "k", "secret_key": "s", "endpoint_override": "host:9000", "scheme": "http", "region": "auto"}
    assert found.for_spark()["spark.hadoop.fs.s3a.endpoint"] == "http://host:9000" and found.for_spark()["spark.hadoop.fs.s3a.access.key"] == "k"
    assert S3Access(anonymous=True).for_arrow() == {"anonymous": True} and S3Access("h").for_arrow()["scheme"] == "https"
    with pytest.raises(ValueError):
        Store.at("s3://")


def test_lines_of_a_trail_are_on_disk_at_once(store, spark):
    w = audit.AuditWriter(store, "r", 0, 0)
    w.append({"attempt": 0, "rank": 0, "world_size": 1, "segment": 0, "step": 0, "position": 0, "block_id": "b", "ts": 1.0})
    assert audit.read_audit(spark, store, "r").count() == 1  # not closed, not flushed
    again = audit.AuditWriter(store, "r", 0, 0)
    again.append({"attempt": 0, "rank": 0, "world_size": 1, "segment": 0, "step": 1, "position": 1, "block_id": "c", "ts": 2.0})
    again.close()
    w.close()
    assert [r.step for r in audit.ordinals(audit.read_audit(spark, store, "r")).orderBy("ordinal").collect()] == [0, 1]
    assert audit.next_attempt(store, "r") == 1


def test_only_named_blocks_are_opened(store, spark):
    log, refs = BlockLog.create(store, 2, 7), make(store, 6)
    log.append(refs[:2])
    log.append(refs[2:4])
    store.write("blocks/b0005.parquet", b"broken orphan")
    assert log.rows(spark).count() == 16 and blocks.read_blocks(spark, store, log.lanes(spark, 0, 2)).count() == 8
    assert [r.x for r in log.rows(spark, 6).collect()] == sorted((r.x for r in log.rows(spark, 6).collect()), key=lambda x: [b.block_id for b in log.read_segment(0).blocks].index(f"b{int(x) // 4:04d}") * 100 + x)


def test_a_segment_file_of_another_log_is_refused(store, spark):
    log, refs = BlockLog.create(store, 2, 7), make(store, 2)
    log.append(refs)
    store.write("log/00000001.json", store.read("log/00000000.json"))
    with pytest.raises(Exception, match="not a segment of this log"):
        log.manifest(spark).collect()


def test_a_broken_write_is_finished_by_writing_again(store, spark):
    register(spark)
    log, refs = BlockLog.create(store, 2, 7), make(store, 6)
    log.append(sorted(refs, key=lambda r: r.block_id)[:2], 0, {"writer": "datasource"})  # the first segment of a write that broke off
    rows = spark.createDataFrame([(r.block_id, r.locator, r.num_rows) for r in refs], blocks.REFS)
    rows.selectExpr("0L as seq", "0L as pass", "0L as pos", "0L as position", "block_id", "locator", "num_rows").write.format("tidelog").mode("append").option("path", store.uri).save()
    assert sorted(r.block_id for r in log.manifest(spark).collect()) == sorted(r.block_id for r in refs)


def test_config_rules():
    for bad in (
        {"checkpoint": {"policy": "every_k", "every_k": None}}, {"checkpoint": {"policy": "time"}}, {"scaling": {"num_workers": [1, 2, 3]}}, {"scaling": {"num_workers": [3, 2]}},
        {"checkpoint": {"num_to_keep": 0}}, {"log": {"wait_poll_s": 0}}, {"parallel": {"outer_lr": 0}}, {"parallel": {"outer_momentum": 1.0}}, {"log": {"W": "x"}}, {"log": 3}, {"log": {"gc": 1}},
    ):
        with pytest.raises(ValueError):
            Config.of(bad)
    c = Config.of({"storage": {"kind": "s3", "endpoint": "http://h:1"}, "store_root": "bucket/x", "log": {"W": 12}})
    assert c.store_root == "s3://bucket/x" and c.storage.access().endpoint == "http://h:1" and c.scaling.bounds() == (2, 2) and c.checkpoint.every_k == 4
    values = {"log": {"W": 4}}
    assert with_overrides(values, ["log.W=8", "train.a.b=[1]"]) == {"log": {"W": 8}, "train": {"a": {"b": [1]}}} and values == {"log": {"W": 4}}
