"""Queries do the whole job, on tables larger than the smallest ones."""

import collections
import hashlib

import numpy as np

from tidelog import catalog


def lines(spark, folder, blocks):
    rows = spark.range(blocks * 100).selectExpr("id AS l_orderkey", "1L AS l_linenumber")
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return sorted((r.l_orderkey, r.l_linenumber, f"b{r.l_orderkey // 100:05d}") for r in rows.collect())


def test_log_roundtrip_gives_back_every_row_once(spark, tmp_path):
    """31 blocks: beyond order key 2400, and no multiple of a segment."""
    want = lines(spark, tmp_path, 31)
    assert sorted(tuple(r) for r in catalog.log_roundtrip(spark, str(tmp_path)).collect()) == want


def test_knn_asks_for_every_hundredth_row_against_all(spark, tmp_path):
    """Ids up to 450 and one far away; the nearest of rows 100 to 400 are among rows 0 to 99."""
    g = np.random.default_rng(3)
    ids = [*range(450), 70_000]
    vectors = {i: g.normal(size=8) for i in ids}
    for q in (100, 200, 300, 400, 70_000):
        vectors[q // 100 % 90 + 1] = 3 * vectors[q]
    rows = [(i, i % 10, vectors[i].astype("float32").tolist()) for i in ids]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    exact, label = {i: np.array(v, float) for i, _, v in rows}, {i: c for i, c, _ in rows}
    near, votes = {}, {}
    for q in (i for i in ids if i % 100 == 0):
        sims = {i: float(exact[q] @ exact[i]) for i in ids if i != q}
        near[q] = sorted(sims, key=lambda i: (-sims[i], i))[:10]
        weights = {}
        for i in near[q]:
            weights[label[i]] = weights.get(label[i], 0.0) + np.exp(sims[i] / 0.1)
        votes[q] = min(weights, key=lambda c: (-weights[c], c))
    found = {}
    for r in catalog.knn_neighbours(spark, str(tmp_path)).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append(r["item"])
    assert found == near and set(near) == {0, 100, 200, 300, 400, 70_000} and min(near[70_000]) < 100
    assert {r["query"]: r["predicted"] for r in catalog.knn_vote(spark, str(tmp_path)).collect()} == votes
    got = catalog.knn_accuracy(spark, str(tmp_path)).first()
    assert got["queries"] == 6 and abs(got["accuracy"] - np.mean([votes[q] == label[q] for q in votes])) < 1e-9


def test_segment_anchors_draw_every_item_twice(spark, tmp_path):
    """1,100 items are more than 20 segments of 48 hold, and two passes no multiple of 48."""
    n = 1100
    spark.range(n).selectExpr("id AS vec_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    drawn = [i for p in range(3) for i in sorted(range(n), key=lambda i: (hashlib.md5(f"7:{p}:{i}".encode()).hexdigest(), i))][: 46 * 48]
    got = sorted((r.seq, r.i, r.segment_pass, r.item) for r in catalog.segment_anchors(spark, str(tmp_path)).collect())
    assert got == [(at // 48, at % 48, at // 48 * 48 // n, item) for at, item in enumerate(drawn)]
    assert set(range(n)) == set(drawn) and min(collections.Counter(drawn).values()) == 2
