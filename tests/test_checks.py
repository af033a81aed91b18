import pytest
from pyspark.sql import functions as F

from tidelog.operators import checks

W = 8
COLUMNS = "attempt long, rank long, world_size long, segment long, step long, position long, block_id string, ts double"


def happy(n=2, segments=2, attempt=0, low=0, high=None):
    rows = []
    for p in range(low, segments * W if high is None else high):
        seg, pos = divmod(p, W)
        rows.append((attempt, pos % n, n, seg, pos // n, p, f"b{p:03d}", seg * 10.0 + pos // n))
    return rows


def found(df):
    return [(r.check_name, r.subject, r.problem) for r in df.collect()]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, COLUMNS)


def test_happy_path_and_faults(frame):
    rows = happy()
    assert found(checks.happy_path(frame(rows), W)) == []
    assert ("coverage", 15, "missing") in found(checks.happy_path(frame(rows[:-1]), W))
    assert ("coverage", 0, "consumed more than once") in found(checks.happy_path(frame(rows + rows[:1]), W))
    moved = rows[:3] + [(*rows[3][:5], 99, *rows[3][6:])] + rows[4:]
    names = found(checks.happy_path(frame(moved), W))
    assert ("dealing", 99, "dealt to the wrong rank or step") in names and ("coverage", 99, "outside the touched segments") in names
    assert any(x[0] == "one_attempt" for x in found(checks.happy_path(frame(rows + happy(attempt=1)), W)))
    assert any(x[0] == "rank_balance" for x in found(checks.happy_path(frame(rows + [rows[0]]), W)))


def test_determinism(frame):
    a = frame(happy()).withColumn("ordinal", F.col("segment") * 4 + F.col("step"))
    assert found(checks.determinism(a, a)) == []
    b = a.withColumn("block_id", F.when((F.col("rank") == 1) & (F.col("ordinal") == 2), "z").otherwise(F.col("block_id")))
    assert found(checks.determinism(a, b)) == [("determinism", 1, "differs at index 2")]
    assert found(checks.determinism(a, a.where("rank = 0"))) == [("determinism", 1, "only one run has this rank")]


def test_resume(frame):
    rows = frame(happy(low=6))
    assert found(checks.resumed(rows, W, start=6)) == [] and found(checks.resumed(rows, W, ledger=(0, 7))) == []
    assert ("resume", 4, "missing") in found(checks.resumed(rows, W, start=4))
    assert ("resume", 6, "extra") in found(checks.resumed(rows, W, start=7))
    assert found(checks.resumed(frame(happy(low=8)), W, ledger=(0, 8), segments=2)) == []
    assert found(checks.resumed(rows, W, start=6, segments=3))
    with pytest.raises(ValueError):
        checks.resumed(rows, W)


def test_recovery(frame):
    good = happy(2, high=10) + happy(4, attempt=1, low=8)
    assert found(checks.recovery(frame(good), W, every_k=2, segments=2, world_sizes=[2, 4])) == []
    assert ("recovery", 1, "gap after 9") in found(checks.recovery(frame(happy(2, high=10) + happy(4, attempt=1, low=12)), W))
    assert ("recovery", 1, "does not start at a step boundary") in found(checks.recovery(frame(happy(2, high=10) + happy(4, attempt=1, low=10)), W))
    assert ("recovery", 1, "replays 10") in found(checks.recovery(frame(happy(2, high=10) + happy(2, attempt=1, low=0)), W, every_k=1))
    assert any("fewer" in x[2] for x in found(checks.recovery(frame(happy()), W)))
    assert found(checks.recovery(frame(good), W, every_k=2, world_sizes=[2, 3])) == [("recovery", 1, "world size 4")]


def ledgers(spark, rows):
    return spark.createDataFrame([(f"checkpoint_g{s:06d}_p{c * n:06d}_n{n:02d}_a00", s, c, n, 0) for s, c, n in rows], "name string, segment long, cursor long, world_size long, run_attempt long")


def test_cadence_and_spacing(spark):
    assert found(checks.cadence(ledgers(spark, [(0, 2, 2), (0, 4, 2)]), W, 2, 2)) == []
    assert len(found(checks.cadence(ledgers(spark, [(0, 3, 2), (0, 4, 2)]), W, 2, 3))) == 2
    two = ledgers(spark, [(0, 3, 2), (1, 2, 2)])
    assert found(checks.time_spacing(two, W, 2, 3)) == [] and len(found(checks.time_spacing(two, W, 4))) == 1
    assert any("fewer" in x[2] for x in found(checks.time_spacing(ledgers(spark, [(0, 1, 2)]), W, 1)))
    wrong = ledgers(spark, [(0, 1, 2)]).withColumn("name", F.lit("checkpoint_x"))
    assert any("called" in x[2] for x in found(checks.cadence(wrong, W, 1)))
    assert found(checks.report_count(spark, 3, 3)) == [] and len(found(checks.report_count(spark, 3, 4))) == 1


def test_streaming(spark, frame):
    rows = frame(happy(segments=3))
    commits = lambda d: spark.createDataFrame(list(d.items()), "segment long, committed double")
    good = {0: -1.0, 1: 9.5, 2: 19.0}
    assert found(checks.streaming(rows, W, commits(good), 8, 3)) == []
    assert any("pace" in x[2] for x in found(checks.streaming(rows, W, commits(good), 11)))
    assert any("never waited" in x[2] for x in found(checks.streaming(rows, W, commits({0: -1.0, 1: 1.0, 2: 2.0}), 8)))
    assert ("streaming", 1, "consumed before its commit") in found(checks.streaming(rows, W, commits({**good, 1: 12.0}), 8))
    assert ("streaming", 2, "no commit time") in found(checks.streaming(rows, W, commits({0: -1.0, 1: 9.5}), 8))


def test_retention(spark):
    kept = spark.createDataFrame([(s, f"b{s}") for s in (7, 8, 9)], "seq long, locator string")
    files = spark.createDataFrame([(f"b{s}",) for s in (7, 8, 9)], "locator string")
    assert found(checks.retention(kept, files, 9, 2)) == []
    assert any("start at 6" in x[2] for x in found(checks.retention(kept, files, 9, 3)))
    assert found(checks.retention(kept.where("seq > 99"), files, 9, 2)) == [("retention", 0, "no segments left in the log")]
    bad = found(checks.retention(kept.where("seq <> 8"), files.where("locator <> 'b7'"), 9, 2))
    assert {x[2] for x in bad} == {"the window has a hole", "missing b7", "orphan b8"}


def test_hook(spark, frame):
    rows = frame(happy(segments=3))
    meta = lambda s, w="remine", t=None: {"writer": w, "mined_after_segment": str(s - 1), "created_at": str(s * 10 - 0.5 if t is None else t)}
    log = lambda metas: spark.createDataFrame([(s, m, [(f"b{p:03d}",) for p in range(s * W, s * W + W)]) for s, m in metas.items()], "seq long, meta map<string,string>, blocks array<struct<block_id:string>>")
    good = {s: meta(s) for s in range(3)}
    assert found(checks.hook_provenance(rows, log(good), W, 1)) == []
    assert ("hook", 2, "consumed but not in the log") in found(checks.hook_provenance(rows, log({s: good[s] for s in (0, 1)}), W, 1))
    assert len(found(checks.hook_provenance(rows, log({**good, 2: meta(2, "batch")}), W, 1))) == 1
    assert ("hook", 2, "committed after its first use") in found(checks.hook_provenance(rows, log({**good, 2: meta(2, t=25)}), W, 1))
    assert ("hook", 2, "committed before the segment before was done") in found(checks.hook_provenance(rows, log({**good, 2: meta(2, t=11)}), W, 1))
