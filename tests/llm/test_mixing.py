import collections
import random

import pytest

from tidelog.llm import common, mixing

from .helpers import awkward, docs, words


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    open_ = set(names)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        open_ -= full
    return target


def check(spark, rows):
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(((i, s, len(words(t))) for i, t, _, s, *_ in rows), key=str)
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    want, taken = plain_targets(sizes), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5000001
    return {(r.doc_id, r.source, r.size, r.tie): r.taken for r in got}


def test_awkward_and_reruns(spark):
    rows = awkward()
    assert check(spark, rows) == check(spark, rows[::-1])


def test_many_rows_hot_source_and_epochs(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 40), "en", "hot" if i % 3 else f"s{r.randint(0, 6)}", 1, "q", "x", 1) for i in range(6000)]
    check(spark, rows)


def test_empty_and_wordless(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    got = mixing.mix(docs(spark, [(1, None, None, "a", None, "q", "x", 1)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)]


def test_stage_repeats_and_cuts(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(20)), "en", f"s{i % 4}", 1, "q", "x", 1) for i in range(40)]
    plan = {r.doc_id: r for r in mixing.mix(docs(spark, rows)).collect()}
    out = mixing.stage(spark, docs(spark, rows), "")
    assert out.columns == docs(spark, rows).columns
    taken = collections.Counter()
    for r in out.collect():
        taken[r.doc_id] += len(words(r.text))
        assert r.text in rows[r.doc_id][1] and r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items()} == {i: r.taken for i, r in plan.items() if r.taken}


def test_repeated_and_null_ids_take_the_exact_budget(spark):
    """Groups of rows that nothing tells apart, some with the cut among them: shares by row, and the stage's words, meet each source's target."""
    r = random.Random(4)
    rows = [(1, "one two three four " * 5, "en", "a", 1, "q", "x", 1)] * 100 + [(None, "five six seven " * 6, None, "b", None, None, "x", 1)] * 100
    rows += [(2, "w " * 40, "en", None, 1, "q", "x", k) for k in range(50)] + [(3, f"t{k} " * r.randint(1, 9), "en", "c", 1, "q", "x", 1) for k in range(80)] + [(4, None, "en", "a", 1, "q", "x", 1)] * 5
    frame = docs(spark, rows).repartition(7)
    frame.write.parquet(path := common.scratch(spark, "t"))
    frame = spark.read.parquet(path)
    check(spark, rows)
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    want, taken = plain_targets(sizes), collections.Counter()
    out = mixing.stage(spark, frame, "").collect()
    for x in out:
        taken[x.source] += len(words(x.text))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5000001, s
    assert any(0 < len(words(x.text)) < 40 for x in out) and {x.hits for x in out if x.source is None} <= set(range(50))


def test_op5_is_the_operator_on_the_whole_table(spark):
    """The registered query: sizes and targets by the contract, shares that meet them, the same again."""
    sf = "/root/testdata/sf0.001"
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = mixing.op5(spark, sf).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in source.values():
        sizes[r.source] += len(words(r.text))
    want = plain_targets(sizes)
    assert len(got) == len(source)
    for r in got:
        d = source[r.doc_id]
        assert (r.size, r.source_size) == (len(words(d.text)), sizes[d.source]) and r.target == pytest.approx(want[d.source]) and 0 <= r.taken <= 3 * r.size
        taken[d.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5000001 for s in sizes)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.op5(spark, sf).collect())
