import numpy as np
import pytest

from tidelog.llm import common, suffix_dedup

from .helpers import awkward, docs, prose, repeats


def check(spark, rows):
    got = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    want = sorted(((i, *x) for (i, *_), x in zip(rows, repeats([t for _, t, *_ in rows]))), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


@pytest.fixture
def passages():
    p = " ".join(prose(8, 40))
    line = prose(1, 41)[0]
    out = [(300 + k, " ".join(prose(5, 500 + k)) + (p if k % 3 == 0 else p[20:260] if k % 3 == 1 else line) + " ".join(prose(5, 700 + k))) for k in range(40)]
    return [*out, (400, p[:199]), (401, p[:200]), (402, "ab" * 300), (403, "ab" * 101), (404, " ".join(prose(4, 44)) * 3)]


def test_awkward(spark, passages):
    check(spark, awkward(passages))


def test_common_anchors_small_chunks_and_batches(spark, passages, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMMON", 3)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BATCH_STRINGS", 50)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    check(spark, awkward(passages))


def test_empty_and_text_kept(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    rows = [(1, "x" * 10 + "q" * 150 + "é" * 100, *awkward()[0][2:]), (2, "y" * 10 + "q" * 150 + "é" * 100, *awkward()[0][2:])]
    assert {r.doc_id: r.kept_bytes for r in suffix_dedup.remove_repeats(docs(spark, rows), keep_text=True).collect()} == {1: b"x" * 10, 2: b"y" * 10}


def test_suffix_arrays_mark_what_two_places_have_and_merge_geometrically(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_STRINGS", 16)
    g = np.random.default_rng(1)
    data = b"".join(b"%0200d" % v for v in g.integers(0, 300, 400))
    family = suffix_dedup.Suffixes(data)
    for at in range(0, 400, 25):
        family.add(np.arange(at, at + 25) * 200)
        assert len(family.levels) <= 5
        for level in filter(lambda x: x is not None, family.levels):  # places in the order of their strings, each string once
            strings = [data[p : p + 200] for p in level.tolist()]
            assert strings == sorted(set(strings))
    values = [data[p : p + 200] for p in range(0, len(data), 200)]
    held = [data[p : p + 200] for level in family.levels if level is not None for p in level.tolist()]
    assert sorted(held) == sorted(set(values))
    marked = {data[p : p + 200] for p in np.flatnonzero(family.marked).tolist()}
    assert marked == {v for v in values if values.count(v) > 1}
    every = suffix_dedup.Suffixes(b"abc" * 300)  # overlapping strings: three distinct ones
    every.add(np.arange(900 - 199))
    assert every.marked[:701].all() and sum(len(x) for x in every.levels if x is not None) == 3


def test_batches_meet_stored_levels(spark, passages, monkeypatch):
    """Five batches added to a family that is opened anew for each: after each, all rows are as brute force over all batches says."""
    monkeypatch.setattr(suffix_dedup, "COMMON", 4)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "BATCH_STRINGS", 100)
    rows = [r for r in awkward(passages) if r[0] != 11]
    parts = [rows[k::5] for k in range(5)]
    folder, seen = common.scratch(spark, "family"), []
    for k, part in enumerate(parts):
        seen += part
        suffix_dedup.Family(spark, folder, shards=8).add(docs(spark, part))
        family = suffix_dedup.Family(spark, folder)
        assert [x["batches"] for x in family.state["levels"]] == {1: [1], 2: [2], 3: [1, 2], 4: [4], 5: [1, 4]}[k + 1]
        if k in (0, 1, 4):
            want = sorted(((i, *x) for (i, *_), x in zip(seen, repeats([t for _, t, *_ in seen]))), key=str)
            assert sorted((tuple(r) for r in family.result().collect()), key=str) == want


def test_a_hot_passage_is_one_context_for_its_shard(spark):
    """Hundreds of texts that share a passage, in many chunks: the shard gets each distinct context once."""
    p = " ".join(prose(8, 77))
    rows = [(k, p, *awkward()[0][2:]) for k in range(300)]
    frame = docs(spark, rows).repartition(12)
    got = suffix_dedup.remove_repeats(frame).collect()
    assert len(got) == 300 and all(r.n_removed == r.n_bytes for r in got)


def test_op10_is_the_operator_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r.doc_id, *x) for r, x in zip(table, repeats([r.text for r in table])))
    assert sorted(tuple(r) for r in suffix_dedup.op10(spark, sf).collect()) == want
