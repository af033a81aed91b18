import numpy as np

from tidelog.llm import components, simhash

from .helpers import awkward, components as plain_components, docs, fingerprint


def check(spark, rows, **kw):
    got = simhash.near_duplicates(docs(spark, rows), **kw).collect()
    assert len(got) == len(rows)
    prints = [fingerprint(t) for _, t, *_ in rows]
    root = plain_components(len(rows), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    low = {}
    for k, (i, *_) in enumerate(rows):
        low[root[k]] = min((x for x in (low.get(root[k]), i) if x is not None), default=None)
    want = sorted(((i, prints[k], low[root[k]]) for k, (i, *_) in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.print % (1 << 64), r.component_id) for r in got), key=str) == want


def test_awkward(spark):
    check(spark, awkward())


def test_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_of_dense_clusters_equal_brute_force(spark):
    """Random centres with points 0 to 5 bits away, in many and in few classes."""
    g = np.random.default_rng(3)
    centres = g.integers(0, 1 << 63, 30, dtype=np.int64).astype(np.uint64)
    points = np.unique(np.concatenate([[c ^ np.uint64(sum(1 << int(b) for b in g.choice(64, k, replace=False))) for k in range(6) for _ in range(4)] for c in centres]))
    prints = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "print long")
    root = plain_components(len(points), lambda i, j: int(np.bitwise_count(points[i] ^ points[j])) <= 4)
    want = {}
    for k, r in enumerate(root):
        want.setdefault(r, set()).add(int(points[k].view(np.int64)))
    for variants in (1 << 24, 1 << 8):
        found = components.components(simhash.links(prints, class_variants=variants)).collect()
        sets = {}
        for r in found:
            sets.setdefault(r.root, {r.root}).add(r.node)
        assert sorted(map(sorted, sets.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert found == {**{i: 0 for i in range(1, 101)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_keeps_one_of_a_group(spark):
    rows = awkward()
    kept = simhash.stage(spark, docs(spark, rows), "")
    assert kept.columns == docs(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids
    prints = [fingerprint(t) for _, t, *_ in rows]
    root = plain_components(len(rows), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    assert len(ids) == len(set(root))  # repeated rows, ties and null ids too


def test_hubs_are_joined_apart(spark, monkeypatch):
    """A star, a path and pairs, where no table of minima may be broadcast whole and nodes of more than three links are hubs."""
    monkeypatch.setattr(components, "HUB", 3)
    fits = components.size_fits
    monkeypatch.setattr(components, "size_fits", lambda df: "n" not in df.columns and fits(df))
    links = [(7, 100 + i) for i in range(60)] + [(i, i + 1) for i in range(300, 340)] + [(500, 501), (7, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    assert found == {**{100 + i: 3 for i in range(60)}, 7: 3, **{i: 300 for i in range(301, 341)}, 501: 500}


def test_op4_is_the_operator_on_the_whole_table_and_links_every_near_pair(spark):
    """The registered query against all pairs of fingerprints; recall of pairs within four bits is whole."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in simhash.op4(spark, sf).collect()}
    assert set(got) == set(texts)
    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    root = plain_components(len(ids), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[r] for r in root]
