import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.operators import hooks, mining, probe, train
from tidelog.plans import policy
from tidelog.operators.writers import write_batch
from tidelog.sources import audit, blocks
from tidelog.sources.log import BlockLog, Ref
from tidelog.sources.storage import Store
from tidelog.streaming.produce import gaussian_corpus, regression_rows


def items(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>")


def test_mining_rules(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.9, 0.1]), (2, 1, [0.0, 1.0]), (3, 1, [0.1, 0.9]), (4, 2, [5.0, 5.0])]
    df = items(spark, rows)
    assert {r.item: r.positive for r in mining.positives(df, 7).collect()} == {0: 1, 1: 0, 2: 3, 3: 2, 4: 4}
    near = mining.near_clusters(mining.centroid_vectors(df), 2)
    assert {(r.cluster, r.j): r.near for r in near.collect()}[(0, 0)] == 1
    label = {i: c for i, c, _ in rows}
    got = mining.negatives(df, near, 7).collect()
    assert len(got) == 10 and all(label[r.negative] != label[r.item] for r in got)
    parked = {r.cluster: r.centroid for r in mining.centroid_vectors(df, clusters=4, dim=2).collect()}
    assert parked[3] == [1e6, 1e6]
    empty = spark.createDataFrame([(0, 0, 9)], "cluster long, j long, near long")
    assert {r.negative for r in mining.negatives(df, empty, 7).collect()} == {2}
    wide = mining.training_rows(df, near, 2, 7)
    assert wide.count() == 5 and wide.columns == ["item", "cluster", "anchor", "positive", "neg_0", "neg_1"]


def test_knn(spark):
    eye = np.eye(4)
    bank = items(spark, [(i, i % 4, eye[i % 4].tolist()) for i in range(12)])
    queries = items(spark, [(100 + i, i, eye[i].tolist()) for i in range(4)])
    assert probe.accuracy(queries, bank, 3, 0.1, 4).first().accuracy == 1.0
    wrong = queries.withColumn("label", (F.col("label") + 1) % 4)
    assert probe.accuracy(wrong, bank, 3, 0.1, 4).first().accuracy == 0.0
    few = {(r["query"], r["rank"]): r["item"] for r in probe.neighbours(queries, bank, 3).collect()}
    assert few == {(r["query"], r["rank"]): r["item"] for r in probe.neighbours(queries, bank, 3, bank_rows=1).collect()}
    with pytest.raises(ValueError):
        probe.accuracy(queries, bank.limit(0), 3, 0.1, 4)
    with pytest.raises(ValueError):
        probe.accuracy(queries, bank, 3, 0.1, 2)


def test_info_nce(spark):
    g = np.random.default_rng(0)
    a, p = g.normal(size=(6, 3)), g.normal(size=(6, 3))
    rows = spark.createDataFrame([(i // 3, i, a[i].tolist(), p[i].tolist()) for i in range(6)], "block long, item long, anchor array<double>, positive array<double>")
    got = {r.block: r.loss for r in mining.info_nce(rows, rows.select("block", "item", F.col("positive").alias("candidate")), 0.5).collect()}
    for b in (0, 1):
        own = range(3 * b, 3 * b + 3)
        want = np.mean([-a[i] @ p[i] / 0.5 + np.log(sum(np.exp(a[i] @ p[j] / 0.5) for j in own)) for i in own])
        assert got[b] == pytest.approx(want)


def test_agreement():
    replicas = [[np.array([1.0, 2.0])], [np.array([3.0, 6.0])]]
    assert np.allclose(train.LocalSGD().agree(replicas)[0], [2, 4])
    assert np.allclose(train.DiLoCo([np.zeros(2)], 1.0, 0.0).agree(replicas)[0], [2, 4])
    outer = train.DiLoCo([np.zeros(2)])
    first = outer.agree(replicas)[0]
    assert np.allclose(first, 0.7 * 1.9 * np.array([2, 4]))
    again = train.DiLoCo([np.ones(2)])
    again.restore(outer.state())
    assert np.allclose(again.agree(replicas)[0], outer.agree(replicas)[0])
    for bad in ({"lr": 0}, {"momentum": 1.0}):
        with pytest.raises(ValueError):
            train.DiLoCo([np.zeros(1)], **bad)
    with pytest.raises(ValueError):
        train.build_sync("fsdp", [])


def test_metrics():
    m = train.Metrics()
    m.add({"loss": 2.0, "name": "x", "flag": True})
    m.add({"loss": 4.0, "extra": 6})
    assert m.flush() == {"loss": 4.0, "extra": 6.0, "loss_mean": 3.0, "extra_mean": 3.0, "steps_in_report": 2} and m.steps == 0


def make(spark, path, n=12, w=6, passes=2):
    store = Store.at(str(path))
    refs = [Ref(*blocks.write_table(store, f"b{i:05d}", regression_rows(16, 3, i))) for i in range(n)]
    log = BlockLog.create(store, w, 7)
    write_batch(log, refs, passes)
    return log


@pytest.mark.parametrize("kind", ["ddp", "local_sgd", "diloco", "none"])
def test_training_learns_and_audits(spark, tmp_path, kind):
    from tidelog.operators import checks

    log, params = make(spark, tmp_path / "s"), [np.zeros(3)]
    sync = train.build_sync(kind, params)
    trainer = train.BlockTrainer(spark, log, params, kind=kind, sync=sync, lr=0.1)
    ledger, reports = trainer.fit()
    assert (ledger.segment, ledger.cursor) == (3, 3) and len(reports) == 4 and reports[-1]["loss"] < reports[0]["loss_mean"]
    assert checks.happy_path(audit.read_audit(spark, log.store, "run"), log.W).count() == 0


def test_stop_and_resume_with_other_world_size(spark, tmp_path):
    from tidelog.operators import checks

    log = make(spark, tmp_path / "s")
    train.BlockTrainer(spark, log, [np.zeros(3)], n=2, policy=policy.EveryKSteps(2), stop_after=5).fit()
    ledger, _ = train.BlockTrainer(spark, log, [np.zeros(3)], n=3, policy=policy.EveryKSteps(2)).fit()
    trail = audit.read_audit(spark, log.store, "run")
    assert checks.recovery(trail, log.W, every_k=2, segments=4, world_sizes=[2, 3]).count() == 0
    points = train.Checkpoints(log.store, "run", None)
    assert points.shape(points.last()) == ("full", 1) and len(points.names()) <= 4
    whole = train.Ledger(0, 3, 2)
    assert train.with_world_size(whole, 3, 6).segment == 1 and train.Ledger.from_json(whole.to_json()[:-1] + ', "x": 1}') == whole


def test_sharded_checkpoints(tmp_path):
    points = train.Checkpoints(Store.at(str(tmp_path)), "r", 1)
    name = points.save(train.Ledger(1, 2, 2), [[np.ones(2)], [np.zeros(2)]], {})
    assert points.shape(name) == ("sharded", 2) and len(points.load(name)[1]) == 2
    points.store.delete(f"r/{name}/shard-00001-of-00002.npz")
    with pytest.raises(FileNotFoundError):
        points.shape(name)


def test_remine_hook(spark, tmp_path):
    vectors, cluster = gaussian_corpus(16, 4, 4, 3)
    store = Store.at(str(tmp_path / "s"))
    log = BlockLog.create(store, 2, 7)
    hook = hooks.RemineHook(spark, (np.arange(16), cluster, vectors), lambda m, v: v * m, batch=4, k=2, segments=3)
    hook.mine(log, 0, None, {"space": "input"})
    for seq in (0, 0, 1, 2):
        hook.on_segment_end(log, seq, np.float32(2.0))
    assert log.seqs() == [0, 1, 2] and log.ended() and log.read_segment(1).meta["mined_after_segment"] == 0
    assert sorted(r.item_id for r in log.rows(spark).where("seq < 2").collect()) == sorted(list(range(16)))
    with pytest.raises(ValueError):
        hooks.RemineHook(spark, (np.arange(15), cluster[:15], vectors[:15]), None, 4, 2, 3).mine(log, 3, None, {})


def test_hook_entries():
    assert hooks.hook_specs({"a": "pkg.mod:attr", "b": {"entry": "m:f", "x": 1}}) == [("a", "pkg.mod:attr", {}), ("b", "m:f", {"x": 1})]
    assert hooks.load_entry("os.path:join")("a", "b") == "a/b"
    with pytest.raises(ValueError):
        hooks.hook_specs({"a": "nope"})


def test_user_function_over_blocks(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("block_id"))
    out = train.map_blocks(df, lambda t: pa.table({"n": pa.array([t.num_rows])}), "n long").collect()
    assert [r.n for r in out] == [5, 5]


def test_a_failed_attempt_leaves_its_trail_and_is_tried_again(spark, tmp_path):
    """The third attempt ends the run; trails of all three pass the recovery check."""
    from tidelog.operators import checks

    log, marker = make(spark, tmp_path / "s"), tmp_path / "failures"
    marker.mkdir()

    def gradient(params, table, info):
        if info.position in (9, 20) and not (marker / str(info.position)).exists():
            (marker / str(info.position)).touch()
            raise OSError("lost")
        return train.linear_gradient(params, table, info)

    sizes = iter([2, 3, 2])
    trainer = train.BlockTrainer(spark, log, [np.zeros(3)], gradient, n=2, policy=policy.EveryKSteps(1))
    ledger, _ = trainer.fit_again(2, lambda: next(sizes))
    trail = audit.read_audit(spark, log.store, "run")
    assert (ledger.run_attempt, ledger.segment) == (2, 3) and trail.select("attempt").distinct().count() == 3
    assert checks.recovery(trail, log.W, every_k=1, least_attempts=3, segments=4).count() == 0
    with pytest.raises(Exception, match="never"):
        train.BlockTrainer(spark, log, [np.zeros(3)], lambda *a: (_ for _ in ()).throw(OSError("never")), run="other").fit_again(1)
    assert train.worker_count(5, 12, 1, 8) == 4 and train.worker_count(9, 12, 2, 3) == 3
    with pytest.raises(RuntimeError):
        train.worker_count(1, 12, 2, 3)


def test_ledgers_without_metadata_and_other_agreement(tmp_path):
    points = train.Checkpoints(Store.at(str(tmp_path)), "r", None)
    names = [points.save(train.Ledger(s, 2, 2), [[np.ones(2)]], {}) for s in range(3)]
    points.store.delete(f"r/{names[1]}/.metadata.json")
    points.store.write(f"r/{names[1]}/model.npz", b"not read")
    assert points.names() == names and points.middle() == names[1] and points.read_ledger(names[1]) == train.Ledger(1, 2, 2)
    outer = train.DiLoCo([np.zeros(2)])
    outer.agree([[np.ones(2)]])
    points.save(train.Ledger(5, 2, 2), [[np.ones(2)]], outer.state())
    again = train.DiLoCo([np.zeros(2)])
    again.restore(points.load(points.last())[2])
    assert np.allclose(again.anchor[0], outer.anchor[0]) and np.allclose(again.velocity[0], outer.velocity[0])
    again.reset([np.full(2, 7.0)])
    assert again.velocity is None and again.anchor[0][0] == 7.0
    with pytest.raises(ValueError):
        train.unpacked(train.packed([np.array([{}], dtype=object)]))


def test_a_run_from_a_configuration(spark, tmp_path):
    from tidelog.config import Config

    log = make(spark, tmp_path / "s")
    config = Config.of({"store_root": log.store.uri, "storage_path": str(tmp_path / "runs"), "run_name": "c", "scaling": {"num_workers": [1, 2]}, "log": {"W": 6}, "train": {"lr": 0.1}, "checkpoint": {"policy": "segment_end"}})
    trainer = train.trainer_of(spark, config, [np.zeros(3)])
    ledger, reports = trainer.fit_again(config.failure.max_failures)
    assert ledger.segment == 3 and len(reports) == 4 and train.Checkpoints(Store.at(str(tmp_path / "runs")), "c").last() is not None


def test_a_log_that_a_hook_began(spark, tmp_path):
    vectors, cluster = gaussian_corpus(16, 4, 4, 3)
    store = Store.at(str(tmp_path / "s"))
    hook = hooks.RemineHook(spark, (np.arange(16), cluster, vectors), lambda m, v: v * m, batch=4, k=2, segments=3)
    log = hooks.ensure_blocks(store, lambda: hooks.initial_log(store, 2, 7, hook, 2))
    assert log.seqs() == [0, 1] and not log.ended() and {log.read_segment(s).meta["space"] for s in (0, 1)} == {"input"}
    assert hooks.ensure_blocks(store, lambda: 1 / 0).seqs() == [0, 1]
    hook.on_segment_end(log, 1, np.float32(2.0))
    assert log.seqs() == [0, 1, 2] and log.read_segment(2).meta["mined_after_segment"] == 1
    assert hooks.remine_args({"remine": {"entry": "m:f", "k": 2}}) == {"k": 2} and hooks.remine_args({"a": "m:f"}) is None
    train.Checkpoints(store, "run").save(train.Ledger(0, 1, 1), [[np.zeros(1)]], {})
    audit.AuditWriter(store, "run", 0, 0).close()
    assert hooks.reset_run(store, "run") == 4 and train.Checkpoints(store, "run").last() is None and audit.next_attempt(store, "run") == 0 and log.seqs() == [0, 1, 2]
    for bad in ("", "log", "a/b"):
        with pytest.raises(ValueError):
            hooks.reset_run(store, bad)


def test_png(tmp_path):
    from tidelog.functions import images

    g = np.random.default_rng(0)
    pixels = [g.integers(0, 256, shape, dtype=np.uint8) for shape in ((5, 7), (4, 3, 3), (1, 1), (9, 2, 3))]
    for x in pixels:
        assert (images.decode_png(images.encode_png(x)) == x).all()
    # rows with each of the five filters, filtered here by their definitions
    import zlib

    x = pixels[1].astype(int)
    up, left = np.vstack([np.zeros((1, 3, 3), int), x[:-1]]), np.concatenate([np.zeros((4, 1, 3), int), x[:, :-1]], axis=1)
    corner = np.vstack([np.zeros((1, 3, 3), int), left[:-1]])
    p = left + up - corner
    near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
    for how, rest in enumerate([0 * x, left, up, (left + up) // 2, near]):
        raw = b"".join(bytes([how]) + bytes(((x - rest) % 256)[y].ravel().tolist()) for y in range(4))
        head = images.encode_png(pixels[1])
        data = head[:33] + images._part(b"IDAT", zlib.compress(raw)) + images._part(b"IEND", b"")
        assert (images.decode_png(data) == pixels[1]).all()
    table = images.images_table(np.stack([pixels[0]] * 2), np.array([1, 2]), np.array([5, 6]))
    assert (images.decode_column(table)[1] == pixels[0]).all()
    for bad in (b"x", images.encode_png(pixels[0])[:-20] + b"y" * 20):
        with pytest.raises(ValueError):
            images.decode_png(bad)
    with pytest.raises(ValueError):
        images.encode_png(np.zeros((2, 2)))
