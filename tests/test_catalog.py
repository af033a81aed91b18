"""Every query of the catalogue against its DuckDB statement, at the smallest size."""

import os

import duckdb
import pytest

from tidelog import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in catalog.oracle_sql():
        rows = duck.sql(catalog.oracle_sql()[name])
        assert sorted(rows.columns) == sorted(df.columns)
        at = [rows.columns.index(c) for c in sorted(df.columns)]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rows.fetchall())


def test_exact_orders_are_permutations(spark):
    rows = catalog.pass_order_exact(spark, SF).collect()
    ids = {r.block_id for r in rows}
    assert all(sorted(r.i for r in rows if r["pass"] == p) == list(range(len(ids))) for p in (0, 1))


def test_entry_survives_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    hidden = {k: None for k in [*[m for m in sys.modules if m.startswith("tidelog.llm")], "tidelog.llm", "tidelog.llm.registry", "corpus_pipeline"]}
    for k, v in hidden.items():
        monkeypatch.setitem(sys.modules, k, v)
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(catalog.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
