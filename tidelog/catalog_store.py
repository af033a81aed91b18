"""Queries that go through a store: blocks, logs, checkpoints, trails and streams are written from the driver's tables and read back.

``catalog`` imports this module, which adds to its registry.
"""

from __future__ import annotations

import io
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _BLOCKS, _LEDGERS, _dealing, _plan, _problem, _trail, block_number, corpus, ledgers, plan, query, table, trail
from .functions import images, names
from .operators import checks, mining, probe, train
from .plans import policy
from .session import shared_folder, stored
from .sources import blocks as B
from .sources.audit import AuditWriter, next_attempt, read_audit
from .sources.log import BlockLog, Ref
from .sources.storage import Store

W, RANKS, SEED = 12, 3, 7


def a_store(spark, name: str) -> Store:
    return Store.at(shared_folder(spark, name))


def sorted_log(spark, sf, ended: bool = True) -> BlockLog:
    """A log of references in the order of their ids, W a segment, what is left over dropped; the blocks themselves aren't read."""
    log = BlockLog.create(a_store(spark, "log"), W, SEED)
    refs = [Ref(r.block_id, f"blocks/{r.block_id}.parquet", r.num_rows) for r in corpus(spark, sf).orderBy("block_id").collect()]  # a row a block
    for at in range(0, len(refs) - W + 1, W):
        log.append(refs[at : at + W], 0, {"writer": "batch", "place": at})
    if ended:
        log.end()
    return log


_SORTED = f"""{_BLOCKS}, sorted AS (SELECT block_id, num_rows, row_number() OVER (ORDER BY block_id) - 1 AS i, count(*) OVER () AS n FROM blocks),
kept AS (SELECT block_id, num_rows, i // 12 AS seq FROM sorted WHERE i < (n // 12) * 12)"""


def lineitem_blocks(spark, sf) -> DataFrame:
    name = F.concat(F.lit("b"), F.lpad(block_number().cast("string"), 5, "0"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", name.alias("block_id"))


# ---- blocks and logs ----


@query("SELECT l_orderkey, l_linenumber, l_quantity, 'b00003' AS block_id FROM lineitem WHERE l_orderkey // 100 = 3")
def read_one_block(spark, sf):
    """All blocks are written, one is read by its locator."""
    store = a_store(spark, "blocks")
    B.write_blocks(lineitem_blocks(spark, sf), store).count()
    return B.read_block(spark, store, names.block_locator("b00003"))


@query(f"""WITH {_BLOCKS} SELECT block_id, num_rows + (block_id LIKE '%7')::INTEGER AS num_rows, CASE WHEN block_id NOT LIKE '%3' THEN num_rows END AS found,
  CASE WHEN block_id LIKE '%3' THEN 'missing' WHEN block_id LIKE '%7' THEN 'rows' ELSE '' END AS problem FROM blocks""")
def block_footers(spark, sf):
    """Rows by the files' footers, where some files are gone and some references are wrong."""
    store = a_store(spark, "blocks")
    refs = stored(B.write_blocks(lineitem_blocks(spark, sf), store), "refs")
    for r in refs.where("block_id LIKE '%3'").collect():
        store.delete(r.locator)
    said = refs.withColumn("num_rows", F.col("num_rows") + F.col("block_id").like("%7").cast("int"))
    found = B.footers(said, store)
    what = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("num_rows"), "rows").otherwise("")
    return found.select("block_id", "num_rows", "found", what.alias("problem"))


@query(f"WITH {_BLOCKS} SELECT block_id AS file, num_rows AS wrong FROM blocks WHERE block_id LIKE '%5'")
def constant_block_ids(spark, sf):
    """Files whose rows name another block than the file is called after."""
    store = a_store(spark, "blocks")
    rows = lineitem_blocks(spark, sf).withColumn("file", F.col("block_id")).withColumn("block_id", F.when(F.col("file").like("%5"), "other").otherwise(F.col("file")))

    def write(key: tuple, found: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        out = io.BytesIO()
        pq.write_table(found.drop_columns(["file"]), out)
        store.write(names.block_locator(key[0].as_py()), out.getvalue())
        return pa.table({"n": pa.array([found.num_rows], pa.int64())})

    rows.groupBy("file").applyInArrow(write, "n long").count()
    return B.constant_problems(spark.read.parquet(store.path("blocks")))


@query(f"WITH {_SORTED} SELECT seq, 0 AS pass, 12 AS \"W\", block_id, num_rows, 'batch' AS writer FROM kept")
def segment_contents(spark, sf):
    """Segments read one by one: their blocks and what was said of them at the commit."""
    log = sorted_log(spark, sf)
    rows = [(s.seq, s.pass_idx, s.W, b.block_id, b.num_rows, s.meta["writer"]) for s in map(log.read_segment, log.seqs()) for b in s.blocks]
    return spark.createDataFrame(rows, "seq long, pass long, W long, block_id string, num_rows long, writer string")


@query(f"""WITH {_SORTED} SELECT seq, true AS found, CAST(sum(num_rows) AS BIGINT) AS num_rows, (SELECT max(seq) FROM kept) AS last_seq, 0 AS first_seq FROM kept GROUP BY seq
UNION ALL SELECT max(seq) + 1, false, NULL, max(seq), 0 FROM kept""")
def log_state(spark, sf):
    """Waiting for each segment and for one behind the end; the first and last numbers."""
    log = BlockLog.open(sorted_log(spark, sf).store)
    rows = []
    for seq in range(log.first_seq(), log.last_seq() + 2):
        s = log.wait_segment(seq, 0.01, 5)
        if log.has_segment(seq) != (s is not None) or not log.ended():
            raise AssertionError("has_segment and wait_segment differ")
        rows.append((seq, s is not None, None if s is None else sum(b.num_rows for b in s.blocks), log.last_seq(), log.first_seq()))
    return spark.createDataFrame(rows, "seq long, found boolean, num_rows long, last_seq long, first_seq long")


@query(f"""WITH {_SORTED}, f AS (SELECT DISTINCT 'log' AS folder, format('{{:08d}}.json', seq) AS name FROM kept UNION ALL SELECT 'log', '_END' UNION ALL SELECT 'log', '_meta.json')
SELECT folder, name, row_number() OVER (ORDER BY name) - 1 AS i FROM f""")
def store_listing(spark, sf):
    """Names of a log's folder, in order."""
    store = sorted_log(spark, sf).store
    return spark.createDataFrame([("log", name, i) for i, name in enumerate(store.names("log"))], "folder string, name string, i long")


@query("SELECT doc_id, source, n_chars, 'd' || lpad(CAST(doc_id // 64 AS VARCHAR), 5, '0') AS block_id FROM documents WHERE doc_id < 128")
def bank_from_log(spark, sf):
    """The first rows of a log in its order: two blocks of 64."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.concat(F.lit("d"), F.lpad(F.floor(F.col("doc_id") / 64).cast("string"), 5, "0")).alias("block_id"))
    store = a_store(spark, "bank")
    refs = sorted(tuple(r) for r in B.write_blocks(rows, store).collect())
    log = BlockLog.create(store, 1, SEED)
    for ref in refs:
        log.append([Ref(*ref)])
    return log.rows(spark, 128).select("doc_id", "source", "n_chars", "block_id")


@query(f"WITH {_BLOCKS}, s AS (SELECT l_orderkey // 100 AS k, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'b' || lpad(CAST(k AS VARCHAR), 5, '0') AS block_id, round(quantity, 4) AS quantity, n FROM s")
def user_function(spark, sf):
    """A user's function over each block, as Arrow tables."""

    def fn(found: pa.Table) -> pa.Table:
        return pa.table({"block_id": [found.column("block_id")[0].as_py()], "quantity": [round(sum(map(float, found.column("l_quantity").to_pylist())), 4)], "n": pa.array([found.num_rows], pa.int64())})

    return train.map_blocks(lineitem_blocks(spark, sf), fn, "block_id string, quantity double, n long")


# ---- streams ----


@query(f"WITH {_SORTED} SELECT seq, k AS rank, 4 AS n, (seq + 2) // 2 AS batches FROM (SELECT DISTINCT seq FROM kept), (SELECT unnest(range(3)) AS k)")
def consumed_segments(spark, sf):
    """A log read as a stream, two segments a trigger, dealt to ranks; how many triggers there were when each segment came.

    A long log is read by several streams; the triggers of the stretches before count for a segment, as they were seen.
    """
    from .streaming.consume import consume_committed

    log, seen = sorted_log(spark, sf), defaultdict(list)

    def batch(rows: DataFrame, stretch: int) -> None:
        found = Counter((r[0], r[1]) for r in rows.select("seq", (F.col("pos") % RANKS).alias("rank")).collect())  # two segments
        if found:
            seen[stretch].append(found)

    consume_committed(spark, log, 2, batch, checkpoint=shared_folder(spark, "offsets"))
    triggers = (found for stretch in sorted(seen) for found in seen[stretch])
    rows = [(seq, rank, n, batches) for batches, found in enumerate(triggers, 1) for (seq, rank), n in found.items()]
    return spark.createDataFrame(rows, "seq long, rank long, n long, batches long")


@query(f"WITH {_SORTED}, l AS (SELECT max(seq) AS last FROM kept) SELECT DISTINCT seq, seq AS consumed FROM kept, l WHERE seq >= last - 2")
def retained_segments(spark, sf):
    """What a consumer with retention 2 leaves of a log, each with its place among the segments it consumed."""
    from .streaming.consume import drain

    log, seen = sorted_log(spark, sf), []
    drain(spark, log, RANKS, lambda rows, seq: seen.append(seq), checkpoint=shared_folder(spark, "offsets"), retention=2)
    return spark.createDataFrame([(seq, seen.index(seq)) for seq in log.seqs()], "seq long, consumed long")


@query(r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS segment, CASE WHEN event_id % 3 = 0 THEN event_id * 0.5 END::DOUBLE AS committed FROM events""")
def commit_lines(spark, sf):
    """A producer's lines: commits with numbers and times among others."""
    n = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("12:00 INFO committed segment "), n, F.lit(" of 12 blocks at "), (F.col("event_id") * 0.5).cast("decimal(20,1)").cast("string"), F.lit(" s")))
    line = F.coalesce(line, F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("waiting for segment "), n)))
    segment, when = names.commit_lines(line)
    return table(spark, sf, "events").select("event_id", segment.alias("segment"), when.alias("committed"))


# ---- checkpoints and trails ----


@query(f"""WITH {_LEDGERS}, o AS (SELECT name, segment, "cursor", row_number() OVER (ORDER BY segment, "cursor", name) - 1 AS i, count(*) OVER () AS n FROM ledgers)
SELECT name, segment, "cursor", 3 AS world_size, CASE WHEN i % 2 = 0 THEN 'full' ELSE 'sharded' END AS shape, CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END AS shards,
       i = n - 1 AS is_last, i = n // 2 AS is_middle, CAST(i AS DOUBLE) AS value FROM o""")
def checkpoint_store(spark, sf):
    """Checkpoints saved and read back: ledgers (some without metadata), shapes, parameters, the last and the middle one."""
    points = train.Checkpoints(a_store(spark, "runs"), "run", None)
    rows = sorted((r.segment, r["cursor"], r.name) for r in ledgers(spark, sf).collect())
    for i, (segment, cursor, name) in enumerate(rows):
        ledger = train.Ledger(segment, cursor, RANKS, 0, 0)
        files = {"model.npz": [np.array([float(i)])]} if i % 2 == 0 else {f"shard-{k:05d}-of-00002.npz": [np.array([float(i)])] for k in range(2)}
        for file, value in files.items():
            points.store.write(f"run/{name}/{file}", train.packed(value))
        points.store.write(f"run/{name}/ledger.json", ledger.to_json().encode())
    found, last, middle = points.ledgers(), points.last(), points.middle()
    out = []
    for name, ledger in found.items():
        kind, shards = points.shape(name)
        _, params, _ = points.load(name)
        out.append((name, ledger.segment, ledger.cursor, ledger.world_size, kind, shards, name == last, name == middle, float(params[-1][0][0])))
    return spark.createDataFrame(out, "name string, segment long, cursor long, world_size long, shape string, shards long, is_last boolean, is_middle boolean, value double")


@query("SELECT unnest(['ledger.json', 'model.npz', '.metadata.json']) AS file, true AS same")
def checkpoint_export(spark, sf):
    """A saved checkpoint copied to another store, file by file."""
    points, target = train.Checkpoints(a_store(spark, "runs"), "run", 2), a_store(spark, "export")
    for segment in range(4):
        name = points.save(train.Ledger(segment, 4, RANKS), [[np.arange(3.0) + segment]], {})
    if len(points.names()) != 2:
        raise AssertionError("two checkpoints are kept")
    points.export(name, target)
    return spark.createDataFrame([(f, target.read(f) == points.store.read(f"run/{name}/{f}")) for f in target.names("")], "file string, same boolean")


@query(f"""WITH {_plan()}, {_trail(3, 0, "a", "position < 45")}, {_trail(3, 1, "b", "position >= 20")}, records AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT attempt::BIGINT AS attempt, count(*) AS records, min(position) AS first_position, max(position) AS last_position, 2 AS next_attempt FROM records GROUP BY 1""")
def audit_attempts(spark, sf):
    """Trails written line by line by two attempts' writers; each attempt's records and the next attempt's number."""
    store, good = a_store(spark, "audit"), plan(spark, sf)
    for attempt, where in ((0, "position < 45"), (1, "position >= 20")):
        writers = [AuditWriter(store, "run", attempt, rank, part_lines=50) for rank in range(RANKS)]
        for r in trail(good, RANKS, attempt).where(where).orderBy("position").toLocalIterator():
            writers[r["rank"]].append(r.asDict())
        for w in writers:
            w.close()
    found = checks.by_attempt(read_audit(spark, store, "run"))
    return found.withColumn("next_attempt", F.lit(next_attempt(store, "run")).cast("long"))


@query("""SELECT w, n, kind, every_k, CAST(CASE WHEN kind = 'never' THEN 1 ELSE 4 * len(list_filter(range(1, w // n + 1), lambda s: (kind <> 'every_k' AND s = w // n) OR (kind IN ('any', 'every_k') AND s % every_k = 0)))
  + CASE WHEN kind = 'every_k' AND (w // n) % every_k <> 0 THEN 1 ELSE 0 END END AS BIGINT) AS reports
FROM (VALUES (12), (24), (60)) t(w), (VALUES (1), (2), (3)) u(n), (VALUES ('any'), ('every_k'), ('segment_end'), ('never')) k(kind), (VALUES (2), (5)) v(every_k)""")
def expected_reports(spark, sf):
    """Reports of a finished run of 4 segments, by policy."""
    rows = [(w, n, kind, k, policy.expected_reports(4, w, n, kind, k)) for w in (12, 24, 60) for n in (1, 2, 3) for kind in ("any", "every_k", "segment_end", "never") for k in (2, 5)]
    return spark.createDataFrame(rows, "w int, n int, kind string, every_k int, reports long")


@query("SELECT w, n, CASE WHEN w % n = 0 THEN w // n END AS steps FROM (SELECT unnest(range(1, 61)) AS w), (SELECT unnest(range(1, 8)) AS n)")
def steps_grid(spark, sf):
    """Steps of a segment for each W and world size, null where it can't be dealt."""
    from .plans.planner import steps_per_segment

    def steps(w, n):
        try:
            return steps_per_segment(w, n)
        except ValueError:
            return None

    return spark.createDataFrame([(w, n, steps(w, n)) for w in range(1, 61) for n in range(1, 8)], "w long, n long, steps long")


@query(f"""WITH {_plan()}, {_trail(2, 0, "a", "position < 45")}, {_trail(4, 1, "b", "position >= 40")}, records AS (SELECT * FROM a UNION ALL SELECT * FROM b), n AS (SELECT count(*) AS n FROM records)
{_problem("transition", "1", "'world size 4'", "(SELECT 1 FROM b LIMIT 1)")} UNION ALL {_problem("report_count", "n", "'expected 7'", "n WHERE n <> 7")}""")
def check_transition(spark, sf):
    """World sizes by attempt against the expected ones, and a count of reports."""
    rows = plan(spark, sf)
    records = stored(checks.union(trail(rows, 2, 0).where("position < 45"), trail(rows, 4, 1).where("position >= 40")), "trail")
    per = records.groupBy("attempt").agg(F.min("world_size").alias("n"))
    found = checks.transition(per, [2, 3]).select(F.lit("transition").alias("check_name"), F.col("attempt").cast("long").alias("subject"), F.concat(F.lit("world size "), F.col("n").cast("string")).alias("problem"))
    return found.unionByName(checks.report_count(spark, records.count(), 7))


@query(f"""WITH {_SORTED}, records AS (SELECT seq AS segment FROM kept), m AS (SELECT max(seq) AS last, count(DISTINCT seq) AS n FROM kept)
{_problem("streaming", "n", "'readers never waited for the producer'", "m")} UNION ALL {_problem("streaming", "n", "'segments start closer than the producer''s pace'", "m WHERE n > 1")} UNION ALL
{_problem("streaming_run", "NULL", "'the producer did not end the log'", "m")} UNION ALL
{_problem("retention", "0", "'the window should start at ' || (last - 2)", "m WHERE last > 2")} UNION ALL
{_problem("retention", "NULL", "'missing blocks/' || block_id || '.parquet'", "kept")} UNION ALL {_problem("retention", "NULL", "'orphan blocks/stray.parquet'", "m")}""")
def check_streaming_run(spark, sf):
    """A store after a streaming run whose log wasn't ended, was kept whole, and has none of its blocks but a stray one."""
    log = sorted_log(spark, sf, ended=False)
    log.store.write("blocks/stray.parquet", b"")
    log.store.write("blocks/stray.parquet.tmp-1", b"")
    dealt = log.manifest(spark).select(
        F.lit(0).cast("long").alias("attempt"), (F.col("pos") % RANKS).alias("rank"), F.lit(RANKS).cast("long").alias("world_size"), F.col("seq").alias("segment"),
        F.floor(F.col("pos") / RANKS).cast("long").alias("step"), "position", "block_id", (F.col("seq") * 10.0 + F.floor(F.col("pos") / RANKS)).cast("double").alias("ts"),
    )
    from .sources.audit import write_audit

    write_audit(dealt, log.store, "run")
    points = train.Checkpoints(log.store, "run", None)
    n = len(log.seqs())
    points.save(train.Ledger(n - 1, W // RANKS, RANKS), [[np.zeros(1)]], {})
    commits = spark.createDataFrame([(s, -1.0) for s in log.seqs()], "segment long, committed double")
    return checks.streaming_run(spark, log, "run", commits, 11.0, n, points, 2)


# ---- vectors and images ----


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding, lambda x: x::DOUBLE * 0.5 + 0.1) AS b, vec_id // 16 AS block FROM embeddings),
d AS (SELECT block, vec_id, a, b FROM v UNION ALL SELECT block, vec_id, b, a FROM v), x AS (SELECT block, vec_id, a, b, row_number() OVER () AS rid FROM d),
l AS (SELECT x.block, x.rid, list_dot_product(x.a, x.b) / 0.5 AS pos, list_dot_product(x.a, CASE WHEN x.b = w.b THEN y.b ELSE y.a END) / 0.5 AS neg
      FROM x JOIN v w ON w.vec_id = x.vec_id JOIN v y ON y.block = x.block AND y.vec_id <> x.vec_id),
r AS (SELECT block, rid, ln(exp(max(pos)) + sum(exp(neg))) - max(pos) AS loss FROM l GROUP BY 1, 2)
SELECT block, round(avg(loss), 5) AS loss, count(*) // 2 AS anchors FROM r GROUP BY 1""")
def nt_xent_loss(spark, sf):
    """Two views of each vector, the loss in both directions over blocks of 16."""
    other = F.transform("embedding", lambda x: x.cast("double") * 0.5 + 0.1)
    views = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("block"), F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("first"), other.alias("second"))
    return mining.nt_xent(views, 0.5).select("block", F.round("loss", 5).alias("loss"), "anchors")


@query("SELECT vec_id, label::BIGINT AS label FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 50")
def seeded_subset(spark, sf):
    return mining.seeded_subset(table(spark, sf, "embeddings"), 50, SEED).select("vec_id", F.col("label").cast("long").alias("label"))


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 = 4 ORDER BY vec_id LIMIT 60), b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 <> 4),
s AS (SELECT q.vec_id AS "query", q.label AS query_label, b.vec_id AS item, b.label AS label, list_dot_product(q.v, b.v) AS sim FROM q, b),
nn AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY sim DESC, item) AS rank FROM s),
votes AS (SELECT "query", query_label, label, sum(exp(sim / 0.1)) AS weight FROM nn WHERE rank <= 10 GROUP BY 1, 2, 3),
pred AS (SELECT "query", query_label, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY weight DESC, label) AS r FROM votes) WHERE r = 1)
SELECT count(*) AS queries, avg((query_label = predicted)::INTEGER::DOUBLE) AS accuracy, 0.1::DOUBLE AS chance, (SELECT count(*) FROM b) AS bank FROM pred""")
def probe_over_store(spark, sf):
    """The log's rows as the bank, the store's held-out rows as queries, the first 60 of them."""
    items = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    store = a_store(spark, "probe")
    name = F.concat(F.lit("v"), F.lpad(F.floor(F.col("vec_id") / 100).cast("string"), 5, "0"))
    refs = sorted(tuple(r) for r in B.write_blocks(items.where("vec_id % 5 <> 4").withColumn("block_id", name), store).collect())
    log = BlockLog.create(store, 1, SEED)
    for ref in refs:
        log.append([Ref(*ref)])
    probe.write_probe_split(items.where("vec_id % 5 = 4").orderBy("vec_id"), store)
    return probe.run_probe(spark, log, 10, 0.1, 10, None, 60)


@query("""SELECT vec_id AS item_id, label::BIGINT AS label, len(embedding) AS width, CAST(list_sum(list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(abs(x::DOUBLE) * 100) AS INTEGER))))) AS BIGINT) AS total FROM embeddings""")
def image_roundtrip(spark, sf):
    """Vectors as one-row grey images, encoded and decoded by tasks."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            pixels = [np.clip(np.floor(np.abs(np.array(v)) * 100), 0, 255).astype(np.uint8)[None, :] for v in batch.column("v").to_pylist()]
            made = images.images_table(pixels, batch.column("label").to_numpy(), batch.column("vec_id").to_numpy())
            back = [images.decode_png(x) for x in made.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [made.column("item_id").combine_chunks(), made.column("label").combine_chunks(), pa.array([x.shape[1] for x in back], pa.int64()), pa.array([int(x.sum()) for x in back], pa.int64())],
                names=["item_id", "label", "width", "total"],
            )

    return rows.mapInArrow(run, "item_id long, label long, width long, total long")
