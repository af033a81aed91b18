"""The k nearest and the rings against plain versions: ties, awkward rows, empty sides, any block size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions.nearest import _best, nearest, sided
from tidelog.functions.numbering import digest_key
from tidelog.operators import mining

COLUMNS = "vec_id long, label long, embedding array<double>"


def by_definition(queries, bank, k, distance, itself):
    out = {}
    for i, _, q in queries:
        scored = []
        for j, _, b in bank:
            if len(q) == len(b) and (itself or i != j):
                total = 0.0
                for x, y in zip(q, b):
                    total += (x - y) * (x - y) if distance else x * y
                scored.append((math.sqrt(total), j) if distance else (-total, j))
        out[i] = [(j, s if distance else -s) for s, j in sorted(scored)[:k]]
    return {i: found for i, found in out.items() if found}


@pytest.mark.parametrize("distance", (False, True))
@pytest.mark.parametrize("itself", (False, True))
@pytest.mark.parametrize("bank_rows", (1, 7, 10_000))
def test_nearest_is_exact(spark, distance, itself, bank_rows):
    g = np.random.default_rng(3)
    common = g.normal(size=5).tolist()
    rows = [(i, i % 3, common if i % 3 == 0 else g.normal(size=5).tolist()) for i in range(60)]  # a third is one vector
    rows += [(100, 1, [1e6] * 5), (101, 1, [0.0] * 5), (102, 2, [1.0, 2.0])]
    awkward = [(None, 1, common), (200, 1, None), (201, 1, [1.0, None, 1.0, 1.0, 1.0]), (202, 1, [math.nan] * 5), (203, 1, [math.inf] * 5)]
    queries = [r for r in rows if r[0] % 10 in (0, 2)]
    both = [sided(spark.createDataFrame(t + awkward, COLUMNS).repartition(3), "vec_id", "label", "embedding") for t in (queries, rows)]
    got = {}
    for r in nearest(*both, 4, distance, itself, bank_rows).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["item"], r["score"]))
    assert got == by_definition(queries, rows, 4, distance, itself)  # the same sums, to the last bit


def test_empty_sides_give_no_row(spark):
    none = sided(spark.createDataFrame([], COLUMNS), "vec_id", "label", "embedding")
    one = sided(spark.createDataFrame([(1, None, [1.0])], COLUMNS), "vec_id", "label", "embedding")
    assert nearest(none, one, 3).count() == nearest(one, none, 3).count() == nearest(one, one, 3, itself=False).count() == 0
    assert nearest(one, one, 3).first().label is None


def test_candidates_outlast_rounding():
    """Vectors far from zero that differ in the last bits: the product's rounding may not choose."""
    g = np.random.default_rng(5)
    b = 1e8 + np.round(g.normal(size=(300, 8)), 3)
    ids = np.arange(300)
    for distance in (False, True):
        qi, bi, score = _best(ids[:20], b[:20], ids, b, 5, distance, True)
        want = by_definition([(i, 0, b[i]) for i in range(20)], [(i, 0, b[i]) for i in range(300)], 5, distance, True)
        assert {i: [(int(j), float(s)) for j, s in zip(bi[qi == i], score[qi == i])] for i in range(20)} == want


def test_ring_of_a_large_cluster(spark):
    rows = [(i, 0 if i < 5000 else i, [0.0]) for i in range(5003)]
    got = mining._ring(spark.createDataFrame(rows, COLUMNS), 7, "vec_id", "label").collect()
    keys = {r["id"]: r["key"] for r in spark.range(5003).select("id", digest_key(7, F.col("id")).alias("key")).collect()}
    order = sorted(range(5000), key=lambda i: (keys[i], i))
    ring = {r.item: (r["at"], r["next"], r["size"]) for r in got}
    assert len(got) == len(ring) == 5003
    assert all(ring[i] == (at, order[(at + 1) % 5000], 5000) for at, i in enumerate(order))
    assert all(ring[i] == (0, i, 1) for i in range(5000, 5003))
    assert mining._ring(spark.createDataFrame([], COLUMNS), 7, "vec_id", "label").count() == 0
