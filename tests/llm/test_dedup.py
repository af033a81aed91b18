import collections
import hashlib

from pyspark.sql import functions as F

from tidelog.llm import common, exact_dedup

from .helpers import awkward, docs, words


def check(spark, rows, **kw):
    """Groups, sizes and digests by row; of each group just one row is kept, and it is the one by length, then id."""
    got = exact_dedup.groups(docs(spark, rows), **kw).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups["".join(words(t))].append((-len(t or ""), i is None, i or 0, i))
    sha = {g: hashlib.sha256(g.encode()).hexdigest() for g in groups}
    want = sorted(((i, min(groups[g])[3], len(groups[g]), sha[g]) for i, t, *_ in rows if (g := "".join(words(t))) is not None), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sorted(((r.doc_id, r.text_sha256) for r in got if r.kept), key=str) == sorted(((min(groups[g])[3], sha[g]) for g in groups), key=str)


def test_awkward(spark):
    check(spark, awkward())


def test_colliding_keys_compare_bytes(spark):
    rows = awkward([(200 + k, f"text {k % 7} " * 20) for k in range(60)])
    check(spark, rows, key=F.length(exact_dedup.normal(exact_dedup.text_of())).cast("long") % 2)
    check(spark, rows, key=F.lit(0).cast("long"), capacity=1)


def test_empty(spark):
    assert exact_dedup.groups(docs(spark, [])).count() == 0


def test_the_longest_of_one_id_stays_alone(spark):
    rows = [(1, t, "en", "s", 1, "q", "x", 1) for t in ("a b c", "a  b  c", "abc")] + [(1, "d e", "en", "s", 1, "q", "x", k) for k in range(4)]
    got = exact_dedup.judged(docs(spark, rows)).collect()
    assert sorted((r.n_cp, r.kept, r.group_size) for r in got) == [(3, False, 3), (3, False, 4), (3, False, 4), (3, False, 4), (3, True, 4), (5, False, 3), (7, True, 3)]
    assert sorted(r.text for r in exact_dedup.stage(spark, docs(spark, rows), "").collect()) == ["a  b  c", "d e"]


def test_directory_doubles_only_where_it_must():
    one = lambda cells: {c: (1, 100) for c in cells}
    bucket, overfull = exact_dedup.directory(one(range(0, 1 << 16, 64)), capacity=300)
    assert len(set(bucket)) == 4 and not overfull.any() and (bucket[1:] >= bucket[:-1]).all() and bucket[(1 << 14) - 1] + 1 == bucket[1 << 14]
    bucket, overfull = exact_dedup.directory({0: (1000, 9), 40000: (5, 9)}, capacity=10)
    assert overfull[0] and overfull.sum() == 1 and bucket[0] != bucket[1] and len(set(bucket[1 << 15 :])) == 1
    bucket, overfull = exact_dedup.directory({0: (2, 900), 1: (2, 900), 9: (1, 5000)}, page_bytes=1000)
    assert len({bucket[0], bucket[1], bucket[9]}) == 3 and not overfull.any()
    assert len(set(exact_dedup.directory({}, 10)[0])) == 1


def test_buckets_split_beyond_the_first_bits(spark):
    """Keys that agree in their first bits, and more: each bucket holds at most its capacity, and all keys of it lie in one range."""
    keys = [(k << 20) + (5 if k % 3 else -(1 << 62)) for k in range(900)]
    frame = spark.createDataFrame([(k, 10) for k in keys], "key long, weight long")
    cells = exact_dedup.grow(frame, 7, 1 << 40)
    found = frame.withColumn("cell", exact_dedup.cell_of(F.col("key"))).join(cells, "cell").select("key", exact_dedup.bucket_of().alias("bucket")).collect()
    assert len(found) == len(keys)
    by = collections.Counter(r.bucket for r in found)
    assert max(by.values()) <= 7
    ordered = [r.bucket for r in sorted(found, key=lambda r: r.key % (1 << 64))]
    assert ordered == sorted(ordered)
    pages = exact_dedup.grow(frame, 1000, 50)
    found = frame.withColumn("cell", exact_dedup.cell_of(F.col("key"))).join(pages, "cell").groupBy(exact_dedup.bucket_of().alias("bucket")).count().collect()
    assert max(r["count"] for r in found) <= 5


def test_a_hot_text_in_many_tasks_reaches_its_owner_in_few_entries(spark, monkeypatch):
    """As many map tasks as rows: the owner of a text gets one entry for each salt, one alone where the text is long."""
    monkeypatch.setattr(exact_dedup, "SALTS", 4)
    monkeypatch.setattr(exact_dedup, "SALTED_BYTES", 5000)
    seen = spark.sparkContext.accumulator(0)
    own = exact_dedup._own

    def counted(key, page):
        seen.add(page.num_rows)
        return own(key, page)

    monkeypatch.setattr(exact_dedup, "_own", counted)
    texts = ["short hot text", "long " * 2000]
    frame = spark.createDataFrame([(k, texts[k % 2]) for k in range(80)], "doc_id long, text string").repartition(40)
    frame.write.parquet(path := common.scratch(spark, "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 40)
    try:
        got = exact_dedup.groups(spark.read.parquet(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 40), (1, 40)} and sum(r.kept for r in got) == 2
    assert 2 <= seen.value <= 5


def test_statement_agrees_and_op8_is_the_operator_on_the_whole_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(exact_dedup.ORACLE_OP8)
    names = sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(r) for r in exact_dedup.op8(spark, sf).select(*names).collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_stage(spark):
    rows = awkward()
    out = exact_dedup.stage(spark, docs(spark, rows), "")
    assert out.columns == docs(spark, rows).columns
    texts = ["".join(words(r.text)) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({"".join(words(t)) for _, t, *_ in rows})
