"""Registry of the engine's queries over the driver's tables, and the DuckDB statements that must give the same rows.

The tables aren't block stores, so logs are derived from them: a block is a hundred order keys of lineitem, a trail is the
plan dealt to ranks with faults put in, arrivals are events, the corpus of vectors is embeddings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import names
from .operators import checks, mining, probe, train
from .plans import planner, policy, shuffle
from .session import shared_folder, stored
from .streaming import writer as stream_writer

SEED, SEGMENT_BLOCKS, RANKS = 7, 12, 3

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _ORACLES[fn.__name__] = sql
        return fn

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)


# ---- derived tables ----


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def block_number() -> Column:
    return planner.div(F.col("l_orderkey"), 100)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("b"), F.lpad(block_number().cast("string"), 5, "0"))
    return table(spark, sf, "lineitem").groupBy(name.alias("block_id")).agg(F.count("*").alias("num_rows"))


def plan(spark: SparkSession, sf: str, passes: int = 1, tail: str = "drop") -> DataFrame:
    return planner.batch_plan(corpus(spark, sf), SEGMENT_BLOCKS, SEED, passes, tail)


def trail(rows: DataFrame, n: int, attempt: int = 0) -> DataFrame:
    """The trail of n ranks that read the plan without a fault."""
    dealt = planner.deal(rows, n)
    return dealt.select(
        F.lit(attempt).cast("long").alias("attempt"), "rank", F.lit(n).cast("long").alias("world_size"), F.col("seq").alias("segment"), "step", "position", "block_id",
        (F.col("seq") * 10 + F.col("step") + F.col("rank") * 0.01).cast("double").alias("ts"),
    )


def faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Some positions missing, some twice, some dealt to the next rank."""
    good = trail(plan(spark, sf), RANKS).where("position % 97 <> 13")
    wrong = good.withColumn("rank", F.when(F.col("position") % 101 == 7, (F.col("rank") + 1) % RANKS).otherwise(F.col("rank")))
    return stored(wrong.unionByName(good.where("position % 89 = 5")), "trail")


_BLOCKS = "blocks AS (SELECT 'b' || lpad(CAST(l_orderkey // 100 AS VARCHAR), 5, '0') AS block_id, count(*) AS num_rows FROM lineitem GROUP BY 1)"


def _ord(passes: int) -> str:
    return f"""{_BLOCKS},
ord AS (
  SELECT block_id, num_rows, pass, row_number() OVER (PARTITION BY pass ORDER BY md5('7:' || pass || ':' || block_id), block_id) - 1 AS i,
         count(*) OVER (PARTITION BY pass) AS n
  FROM blocks, (SELECT unnest(range({passes})) AS pass)
)"""


def _plan(passes: int = 1) -> str:
    return f"""{_ord(passes)},
chunks AS (SELECT pass, block_id, num_rows, i // 12 AS chunk, i % 12 AS slot, n // 12 AS chunks FROM ord WHERE i < (n // 12) * 12),
numbered AS (SELECT *, pass * chunks + chunk AS seq FROM chunks),
plan AS (
  SELECT *, seq * 12 + pos AS position FROM (
    SELECT seq, pass, slot, block_id, num_rows, row_number() OVER (PARTITION BY seq ORDER BY md5('7:' || seq || ':' || block_id), block_id, slot) - 1 AS pos FROM numbered)
)"""


def _trail(n: int = 3, attempt: int = 0, name: str = "good", where: str = "true") -> str:
    return f"""{name} AS (
  SELECT {attempt} AS attempt, pos % {n} AS rank, {n} AS world_size, seq AS segment, pos // {n} AS step, position, block_id,
         CAST(seq * 10 + pos // {n} + (pos % {n}) * 0.01 AS DOUBLE) AS ts
  FROM plan WHERE {where}
)"""


_FAULTY = f"""{_plan()},
{_trail(where="position % 97 <> 13")},
records AS (
  SELECT attempt, CASE WHEN position % 101 = 7 THEN (rank + 1) % 3 ELSE rank END AS rank, world_size, segment, step, position, block_id, ts FROM good
  UNION ALL SELECT * FROM good WHERE position % 89 = 5
)"""


def _problem(check: str, subject: str, problem: str, source: str) -> str:
    return f"SELECT '{check}' AS check_name, CAST({subject} AS BIGINT) AS subject, {problem} AS problem FROM {source}"


def _dealing(records: str = "records") -> str:
    return _problem("dealing", "position", "'dealt to the wrong rank or step'", f"{records} WHERE position <> segment * 12 + step * world_size + rank")


def _coverage(records: str = "records") -> str:
    owned = f"(SELECT DISTINCT segment * 12 + k AS position FROM {records}, (SELECT unnest(range(12)) AS k))"
    counts = f"(SELECT position, count(*) AS n FROM {records} GROUP BY 1)"
    return " UNION ALL ".join([
        _problem("coverage", "o.position", "'missing'", f"{owned} o ANTI JOIN {counts} c ON o.position = c.position"),
        _problem("coverage", "position", "'consumed more than once'", f"{counts} WHERE n > 1"),
        _problem("coverage", "c.position", "'outside the touched segments'", f"{counts} c ANTI JOIN {owned} o ON o.position = c.position"),
    ])


def _balance(records: str = "records") -> str:
    return _problem(
        "rank_balance", "rank", "n || ' blocks of ' || most",
        f"(SELECT rank, n, max(n) OVER () AS most FROM (SELECT rank, count(*) AS n FROM {records} GROUP BY 1)) WHERE n < most",
    )


def _one_attempt(records: str = "records") -> str:
    return _problem("one_attempt", "n", "'a run without failures has one attempt'", f"(SELECT count(DISTINCT attempt) AS n FROM {records}) WHERE n <> 1")


def _duplicates(records: str = "records") -> str:
    return _problem(
        "duplicates", "position", "'consumed ' || n || ' times in attempt ' || attempt", f"(SELECT attempt, position, count(*) AS n FROM {records} GROUP BY 1, 2) WHERE n > 1"
    )


def _happy(records: str = "records") -> str:
    return " UNION ALL ".join([_one_attempt(records), _dealing(records), _coverage(records), _balance(records)])


# ---- blocks and plans ----


@query(f"WITH {_BLOCKS} SELECT block_id, 'blocks/' || block_id || '.parquet' AS locator, num_rows FROM blocks")
def block_manifest(spark, sf):
    return corpus(spark, sf).select("block_id", F.concat(F.lit("blocks/"), "block_id", F.lit(".parquet")).alias("locator"), "num_rows")


@query(f"WITH {_ord(2)} SELECT pass, i, block_id FROM ord")
def pass_order_md5(spark, sf):
    return planner.pass_order(corpus(spark, sf), SEED, 2).select("pass", "i", "block_id")


@query()
def pass_order_exact(spark, sf):
    return shuffle.exact_passes(corpus(spark, sf), SEED, 2)


@query(f"WITH {_ord(1)} SELECT pass, i // 12 AS chunk, i % 12 AS slot, block_id FROM ord WHERE i < (n // 12) * 12")
def cut_segments_drop(spark, sf):
    return planner.cut_segments(planner.pass_order(corpus(spark, sf), SEED), SEGMENT_BLOCKS, "drop").select("pass", "chunk", "slot", "block_id")


@query(f"""WITH {_ord(1)}, slots AS (SELECT unnest(range(CAST(ceil(max(n) / 12.0) * 12 AS BIGINT))) AS g, max(n) AS n FROM ord)
SELECT pass, g // 12 AS chunk, g % 12 AS slot, block_id FROM slots JOIN ord ON ord.i = slots.g % slots.n""")
def cut_segments_wrap(spark, sf):
    return planner.cut_segments(planner.pass_order(corpus(spark, sf), SEED), SEGMENT_BLOCKS, "wrap").select("pass", "chunk", "slot", "block_id")


@query(f"WITH {_plan(2)} SELECT seq, pass, pos, position, block_id, num_rows FROM plan")
def batch_plan_two_pass(spark, sf):
    return plan(spark, sf, 2).select("seq", "pass", "pos", "position", "block_id", "num_rows")


@query()
def batch_plan_exact(spark, sf):
    chunks = planner.cut_segments(planner.pass_order(corpus(spark, sf), SEED), SEGMENT_BLOCKS, "drop").withColumnRenamed("chunk", "seq")
    return shuffle.exact_segments(chunks, SEED)


@query(f"WITH {_plan(1)} SELECT seq, seq * 12 + k AS position FROM (SELECT DISTINCT seq FROM plan), (SELECT unnest(range(12)) AS k)")
def segment_positions(spark, sf):
    return planner.positions(plan(spark, sf).select("seq").distinct(), SEGMENT_BLOCKS)


@query(f"WITH {_plan(1)} SELECT seq, pos % 3 AS rank, pos // 3 AS step, position, block_id FROM plan")
def lane_deal(spark, sf):
    return planner.deal(plan(spark, sf), RANKS).select("seq", "rank", "step", "position", "block_id")


@query(f"WITH {_plan(1)} SELECT seq, pos % 4 AS rank, pos // 4 AS step, position, block_id FROM plan WHERE seq > 2 OR (seq = 2 AND pos // 4 >= 1)")
def lane_resume(spark, sf):
    return planner.resume(plan(spark, sf), SEGMENT_BLOCKS, 2, 2, 3, 4).select("seq", "rank", "step", "position", "block_id")


@query("""WITH g AS (SELECT n_old, n_new, c AS "cursor" FROM (SELECT unnest(range(1, 7)) AS n_old), (SELECT unnest(range(1, 7)) AS n_new), (SELECT unnest(range(0, 61)) AS c) WHERE c * n_old <= 60)
SELECT n_old, n_new, "cursor", CASE WHEN "cursor" * n_old = 60 THEN 4 ELSE 3 END::BIGINT AS start_segment,
  CASE WHEN "cursor" * n_old = 60 THEN 0 ELSE ("cursor" * n_old) // n_new END::BIGINT AS start_step,
  CASE WHEN "cursor" * n_old = 60 THEN 0 ELSE ("cursor" * n_old) % n_new END::BIGINT AS replayed FROM g""")
def resume_grid(spark, sf):
    """Every cursor and pair of world sizes from 1 to 6 for a segment of 60 blocks."""
    grid = spark.range(1, 7).select(F.col("id").alias("n_old")).join(spark.range(1, 7).select(F.col("id").alias("n_new")), F.lit(True))
    grid = grid.withColumn("cursor", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(60) / F.col("n_old")).cast("long"))))
    out = planner.resume_columns(F.lit(60), F.lit(3).cast("long"), F.col("cursor"), F.col("n_old"), F.col("n_new"))
    return grid.select("n_old", "n_new", "cursor", *[c.alias(k) for k, c in out.items()])


@query(f"WITH {_plan(2)} SELECT seq, pass, coalesce(lead(pass) OVER (ORDER BY seq) <> pass, true) AS boundary FROM (SELECT DISTINCT seq, pass FROM plan)")
def pass_boundaries(spark, sf):
    return planner.next_pass_differs(plan(spark, sf, 2).select("seq", "pass").distinct(), ended=True)


@query(f"WITH {_plan(2)} SELECT seq FROM (SELECT DISTINCT seq FROM plan WHERE seq <> 5) WHERE seq < 5")
def contiguous_segments(spark, sf):
    return planner.contiguous_prefix(plan(spark, sf, 2).where("seq <> 5").select("seq").distinct())


@query(f"WITH {_plan(2)} SELECT block_id, arg_min(num_rows, position) AS num_rows, min(position) AS first_position FROM plan GROUP BY 1")
def distinct_refs_first_wins(spark, sf):
    return planner.first_refs(plan(spark, sf, 2))


@query("""WITH n AS (SELECT count(*) AS n, CAST(ceil(2 * count(*) / 48.0) * 48 AS BIGINT) AS places FROM embeddings),
e AS (SELECT vec_id AS item, pass, pass * n + row_number() OVER (PARTITION BY pass ORDER BY md5('7:' || pass || ':' || vec_id), vec_id) - 1 AS place, n, places
      FROM embeddings, n, (SELECT unnest(range((SELECT (places - 1) // n + 1 FROM n))) AS pass))
SELECT place // 48 AS seq, place % 48 AS i, ((place // 48) * 48) // n AS segment_pass, item FROM e WHERE place < places""")
def segment_anchors(spark, sf):
    """Two whole passes at least: every item is drawn, and segments run across the end of a pass."""
    items = table(spark, sf, "embeddings")
    n = items.count()
    return planner.segment_anchors(items, "vec_id", 48, -(-2 * n // 48), SEED, n)


@query("""SELECT * FROM (SELECT block_id, NOT (block_id = '' OR contains(block_id, '/') OR starts_with(block_id, '.')) AS valid_id,
  NOT (list_contains(string_split(locator, '/'), '') OR list_contains(string_split(locator, '/'), '..')) AS valid_locator
FROM (SELECT url AS locator, regexp_replace(url, '^https?:/', '') AS block_id FROM pages UNION ALL SELECT 'blocks/' || page_id, CAST(page_id AS VARCHAR) FROM pages))""")
def name_validation(spark, sf):
    pages = table(spark, sf, "pages")
    rows = pages.select(F.col("url").alias("locator"), F.regexp_replace("url", "^https?:/", "").alias("block_id"))
    rows = rows.unionByName(pages.select(F.concat(F.lit("blocks/"), F.col("page_id").cast("string")).alias("locator"), F.col("page_id").cast("string").alias("block_id")))
    return rows.select("block_id", names.valid_block_id(F.col("block_id")).alias("valid_id"), names.valid_locator(F.col("locator")).alias("valid_locator"))


# ---- policies ----


def steps(spark, sf) -> DataFrame:
    """The steps of three ranks over two passes."""
    ends = planner.next_pass_differs(plan(spark, sf, 2).select("seq", "pass").distinct(), ended=True)
    n = SEGMENT_BLOCKS // RANKS
    rows = ends.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    place = F.col("seq") * n + F.col("step") - 1
    return rows.select(F.lit("run").alias("run"), place.alias("place"), "seq", "step", F.lit(n).cast("long").alias("steps"), (F.col("boundary") & (F.col("step") == n)).alias("pass_ends"), (place * 1.5).cast("double").alias("elapsed"))


_STEPS = f"""{_plan(2)},
segs AS (SELECT seq, coalesce(lead(pass) OVER (ORDER BY seq) <> pass, true) AS boundary FROM (SELECT DISTINCT seq, pass FROM plan)),
steps AS (SELECT seq * 4 + step - 1 AS place, seq, step, boundary AND step = 4 AS pass_ends FROM segs, (SELECT unnest(range(1, 5)) AS step))"""


def _fires(spark, sf, *args, **kw):
    return policy.decisions(steps(spark, sf), lambda: policy.build_policy(*args, **kw)).select("place", "fires")


@query(f"WITH {_STEPS} SELECT place, step % 3 = 0 AS fires FROM steps")
def policy_every_k(spark, sf):
    return _fires(spark, sf, "every_k", 3)


@query(f"WITH {_STEPS} SELECT place, false AS fires FROM steps")
def policy_never(spark, sf):
    return _fires(spark, sf, "never")


@query(f"WITH {_STEPS} SELECT place, step = 4 AS fires FROM steps")
def policy_segment_end(spark, sf):
    return _fires(spark, sf, "segment_end")


@query(f"WITH {_STEPS} SELECT place, pass_ends AS fires FROM steps")
def policy_pass_end(spark, sf):
    return _fires(spark, sf, "pass_end")


@query(f"WITH {_STEPS} SELECT place, step % 3 = 0 OR step = 4 OR pass_ends AS fires FROM steps")
def policy_any(spark, sf):
    return _fires(spark, sf, "any", 3)


def _timed(tests: str, seconds: float, poll: int) -> str:
    """Steps of 1.5 s in order: tests on a step, or a budget asked on every poll-th step; the budget's clock starts again at each checkpoint."""
    due = f"(({tests}) OR (s.place + 1) % {poll} = 0 AND s.place * 1.5 - f.since >= {seconds})"
    return f"""WITH RECURSIVE {_STEPS},
f(place, since, fires) AS (
  SELECT -1::BIGINT, 0.0::DOUBLE, false UNION ALL
  SELECT s.place, CASE WHEN {due} THEN s.place * 1.5 ELSE f.since END::DOUBLE, {due} FROM f JOIN steps s ON s.place = f.place + 1
) SELECT place, fires FROM f WHERE place >= 0"""


@query(_timed("false", 7.0, 2))
def policy_time_budget(spark, sf):
    return _fires(spark, sf, "time", time_budget_s=7.0, poll_every=2)


@query(_timed("s.step % 3 = 0 OR s.step = 4 OR s.pass_ends", 2.0, 3))
def policy_any_with_budget(spark, sf):
    """A budget among other rules: their checkpoints restart its clock, its poll goes on."""
    return _fires(spark, sf, "any", 3, time_budget_s=2.0, poll_every=3)


@query(f"""WITH {_STEPS} SELECT place, format('checkpoint_g{{:06d}}_p{{:06d}}_n03_a00', seq, step * 3) AS name FROM steps WHERE step % 3 = 0 OR step = 4""")
def checkpoint_names(spark, sf):
    rows = policy.decisions(steps(spark, sf), lambda: policy.build_policy("any", 3)).where("fires")
    return rows.select("place", names.checkpoint_name_col(F.col("seq"), F.col("step"), F.lit(RANKS), F.lit(0)).alias("name"))


@query("""SELECT w, n, k, segment_end, CAST(4 * len(list_filter(range(1, w // n + 1), lambda s: (segment_end AND s = w // n) OR (k > 0 AND s % greatest(k, 1) = 0))) AS BIGINT) AS checkpoints
FROM (VALUES (12), (24), (60)) t(w), (VALUES (1), (2), (3)) u(n), (VALUES (0), (2), (5)) v(k), (VALUES (true), (false)) x(segment_end)""")
def expected_checkpoints(spark, sf):
    """Closed-form counts for 4 segments; k = 0 is no every-k rule."""
    rows = spark.createDataFrame([(w, n, k, e) for w in (12, 24, 60) for n in (1, 2, 3) for k in (0, 2, 5) for e in (True, False)], "w int, n int, k int, segment_end boolean")
    per = F.sequence(F.lit(1), F.expr("w div n").cast("int"))
    hits = F.filter(per, lambda s: (F.col("segment_end") & (s == F.expr("w div n"))) | ((F.col("k") > 0) & (s % F.greatest("k", F.lit(1)) == 0)))
    return rows.withColumn("checkpoints", (F.size(hits) * 4).cast("long"))


@query("""WITH e AS (SELECT user_id % 50 AS run, event_id AS step, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, event_id % 10 = 9 AS report FROM events),
w AS (SELECT *, coalesce(sum(CAST(report AS BIGINT)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS win FROM e)
SELECT run, CAST(win AS BIGINT) AS "window", round(arg_max(value, step) FILTER (value IS NOT NULL), 6) AS last_value, round(sum(value) / count(*), 6) AS value_mean, count(*) AS steps_in_report FROM w GROUP BY 1, 2""")
def metric_windows(spark, sf):
    events = table(spark, sf, "events")
    rows = events.select((F.col("user_id") % 50).alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), (F.col("event_id") % 10 == 9).alias("report"))
    out = train.metric_windows(rows)
    return out.select("run", "window", F.round("last_value", 6).alias("last_value"), F.round("value_mean", 6).alias("value_mean"), "steps_in_report")


# ---- checks ----


@query(f"""WITH {_FAULTY} SELECT attempt::BIGINT AS attempt, string_agg(DISTINCT world_size::VARCHAR, ',') AS world_sizes, array_to_string(list_sort(list_distinct(list(rank))), ',') AS ranks, count(*) AS records,
  min(segment) AS first_segment, max(segment) AS last_segment, min(position) AS first_position, max(position) AS last_position FROM records GROUP BY 1""")
def audit_summary(spark, sf):
    return checks.summary(faulty(spark, sf))


@query(f"WITH {_FAULTY} {_dealing()}")
def check_dealing(spark, sf):
    return checks.dealing(faulty(spark, sf), SEGMENT_BLOCKS)


@query(f"WITH {_FAULTY} {_coverage()}")
def check_coverage(spark, sf):
    return checks.coverage(faulty(spark, sf), SEGMENT_BLOCKS)


@query(f"WITH {_FAULTY} {_balance()}")
def check_rank_balance(spark, sf):
    return checks.rank_balance(faulty(spark, sf))


@query(f"WITH {_FAULTY} {_duplicates()}")
def check_duplicates(spark, sf):
    return checks.duplicates(faulty(spark, sf))


@query(f"WITH {_FAULTY} {_happy()}")
def check_happy_path(spark, sf):
    return checks.happy_path(faulty(spark, sf), SEGMENT_BLOCKS)


@query(f"""WITH {_plan()}, {_trail(name="a")},
x AS (SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY position) - 1 AS ordinal, block_id FROM a),
y AS (SELECT rank, ordinal, CASE WHEN rank = 1 AND ordinal = 2 THEN 'other' ELSE block_id END AS block_id FROM x WHERE rank <> 2),
j AS (SELECT coalesce(x.rank, y.rank) AS rank, coalesce(x.ordinal, y.ordinal) AS ordinal, x.block_id AS p, y.block_id AS q FROM x FULL JOIN y ON x.rank = y.rank AND x.ordinal = y.ordinal),
d AS (SELECT rank, min(ordinal) FILTER (p IS DISTINCT FROM q) AS place, count(p) AS in_a, count(q) AS in_b FROM j GROUP BY 1)
{_problem("determinism", "rank", "'only one run has this rank'", "d WHERE in_a = 0 OR in_b = 0")} UNION ALL
{_problem("determinism", "rank", "'differs at index ' || place", "d WHERE in_a > 0 AND in_b > 0 AND place IS NOT NULL")}""")
def check_determinism(spark, sf):
    from .sources.audit import ordinals

    a = ordinals(trail(plan(spark, sf), RANKS).withColumns({"part": F.lit(0), "line": F.col("position")}))
    b = a.where("rank <> 2").withColumn("block_id", F.when((F.col("rank") == 1) & (F.col("ordinal") == 2), "other").otherwise(F.col("block_id")))
    return checks.determinism(a, b)


@query(f"""WITH {_plan()}, {_trail(n=4, name="a", where="position >= 33")}, records AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE position % 50 = 0),
f AS (SELECT 2 * 12 + 6 // 4 * 4 AS lo, (max(segment) + 1) * 12 AS hi FROM records),
due AS (SELECT unnest(range(lo, hi)) AS position FROM f), c AS (SELECT position, count(*) AS n FROM records GROUP BY 1)
{_dealing()} UNION ALL {_problem("resume", "d.position", "'missing'", "due d ANTI JOIN c ON d.position = c.position")} UNION ALL
{_problem("resume", "c.position", "'extra'", "c ANTI JOIN due d ON d.position = c.position")} UNION ALL {_problem("resume", "position", "'consumed more than once'", "c WHERE n > 1")}""")
def check_resume(spark, sf):
    rows = stored(trail(plan(spark, sf), 4).where("position >= 33"), "trail")
    return checks.resumed(rows.unionByName(rows.where("position % 50 = 0")), SEGMENT_BLOCKS, ledger=(2, 6))


@query(f"""WITH {_plan()}, {_trail(2, 0, "a", "position < 45")}, {_trail(3, 1, "b", "position >= 20 AND position < 60")}, {_trail(4, 2, "c", "position >= 65")},
records AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
per AS (SELECT attempt, min(position) AS first, max(position) AS last, min(world_size) AS n, count(DISTINCT world_size) AS sizes FROM records GROUP BY 1),
moves AS (SELECT *, lag(attempt) OVER w AS before, lag(last) OVER w AS last_before, lag(n) OVER w AS n_before FROM per WINDOW w AS (ORDER BY attempt)),
moved AS (SELECT m.*, (SELECT count(*) FROM records r WHERE r.attempt = m.before AND r.position >= m.first) AS replayed FROM moves m WHERE before IS NOT NULL)
{_dealing()} UNION ALL {_duplicates()} UNION ALL
{_problem("recovery", "n", "'fewer than 2 attempts'", "(SELECT count(*) AS n FROM per) WHERE n < 2")} UNION ALL
{_problem("recovery", "attempt", "'mixed world sizes'", "per WHERE sizes > 1")} UNION ALL
{_problem("recovery", "attempt", "'gap after ' || last_before", "moved WHERE first > last_before + 1")} UNION ALL
{_problem("recovery", "attempt", "'does not start at a step boundary'", "moved WHERE (first % 12) % n <> 0")} UNION ALL
{_problem("recovery", "attempt", "'replays ' || replayed", "moved WHERE replayed > 2 * 4 * n_before + n")} UNION ALL
{_problem("recovery", "position", "'never consumed'", "(SELECT unnest(range((SELECT (max(segment) + 1) * 12 FROM records))) AS position) d ANTI JOIN records r USING (position)")}""")
def check_recovery(spark, sf):
    rows = plan(spark, sf)
    parts = [trail(rows, 2, 0).where("position < 45"), trail(rows, 3, 1).where("position >= 20 and position < 60"), trail(rows, 4, 2).where("position >= 65")]
    return checks.recovery(stored(checks.union(*parts), "trail"), SEGMENT_BLOCKS, every_k=4)


def ledgers(spark, sf) -> DataFrame:
    rows = policy.decisions(steps(spark, sf), lambda: policy.build_policy("any", 3)).where("fires")
    cursor = F.when(F.col("place") % 11 == 3, F.lit(1)).otherwise(F.col("step")).cast("long")
    return rows.select(
        names.checkpoint_name_col(F.col("seq"), F.col("step"), F.lit(RANKS), F.lit(0)).alias("name"), F.col("seq").alias("segment"), cursor.alias("cursor"),
        F.lit(RANKS).cast("long").alias("world_size"), F.lit(0).cast("long").alias("run_attempt"),
    )


_LEDGERS = f"""{_STEPS},
ledgers AS (SELECT format('checkpoint_g{{:06d}}_p{{:06d}}_n03_a00', seq, step * 3) AS name, seq AS segment, CASE WHEN place % 11 = 3 THEN 1 ELSE step END AS "cursor" FROM steps WHERE step % 3 = 0 OR step = 4)"""


@query(f"""WITH {_LEDGERS}, n AS (SELECT *, segment * 12 + "cursor" * 3 AS place, format('checkpoint_g{{:06d}}_p{{:06d}}_n03_a00', segment, "cursor" * 3) AS named FROM ledgers)
{_problem("cadence", "place", "'neither a multiple of k nor the segment''s end'", 'n WHERE NOT ("cursor" = 4 OR "cursor" % 3 = 0)')} UNION ALL
{_problem("cadence", "place", "'should be called ' || named", "n WHERE name <> named")} UNION ALL
{_problem("cadence", "n", "'expected 7 checkpoints'", "(SELECT count(*) AS n FROM n) WHERE n <> 7")}""")
def check_cadence(spark, sf):
    return checks.cadence(ledgers(spark, sf), SEGMENT_BLOCKS, 3, 7)


@query(f"""WITH {_LEDGERS}, n AS (SELECT *, segment * 12 + "cursor" * 3 AS place FROM ledgers), g AS (SELECT *, lag(place) OVER (ORDER BY place) AS before FROM n)
{_problem("time_spacing", "place", "'closer than the poll to ' || before", "g WHERE place - before < 6")}""")
def check_time_spacing(spark, sf):
    return checks.time_spacing(ledgers(spark, sf), SEGMENT_BLOCKS, 2)


@query(f"""WITH {_LEDGERS}, f AS (SELECT segment, CASE WHEN segment % 4 = 1 THEN 4 ELSE 3 END AS n, CASE WHEN segment % 5 = 2 THEN 0 WHEN segment % 7 = 3 THEN 9 ELSE "cursor" END AS c FROM ledgers),
x AS (SELECT *, segment * 12 + c * n AS place FROM f), g AS (SELECT *, lag(place) OVER (ORDER BY place) AS before FROM x), t AS (SELECT count(*) AS n, count(DISTINCT x.n) AS sizes, min(x.n) AS least FROM x)
{_problem("time_spacing", "n", "'fewer than two checkpoints'", "t WHERE n < 2")} UNION ALL {_problem("time_spacing", "sizes", "'several world sizes'", "t WHERE sizes > 1")} UNION ALL
{_problem("time_spacing", "place", "'closer than the poll to ' || before", "g WHERE place - before < 2 * (SELECT least FROM t)")} UNION ALL
{_problem("time_spacing", "place", "'not a step boundary'", "x WHERE c <= 0 OR c * n > 12")} UNION ALL {_problem("time_spacing", "n", "'1 reports'", "t WHERE n NOT IN (0, 1)")}""")
def check_time_spacing_faults(spark, sf):
    """Checkpoints of several world sizes, off the steps, too close, and too few reports."""
    n = F.when(F.col("segment") % 4 == 1, 4).otherwise(RANKS).cast("long")
    cursor = F.when(F.col("segment") % 5 == 2, 0).when(F.col("segment") % 7 == 3, 9).otherwise(F.col("cursor")).cast("long")
    return checks.time_spacing(ledgers(spark, sf).withColumns({"world_size": n, "cursor": cursor}), SEGMENT_BLOCKS, 2, 1)


@query(f"""WITH {_FAULTY} SELECT segment, round(min(ts), 6) AS "start", round(max(ts), 6) AS stop, round(min(ts) - lag(min(ts)) OVER (ORDER BY segment), 6) AS gap FROM records GROUP BY segment""")
def segment_gaps(spark, sf):
    return checks.segment_gaps(faulty(spark, sf)).select("segment", *[F.round(c, 6).alias(c) for c in ("start", "stop", "gap")])


@query(f"""WITH {_FAULTY},
commits AS (SELECT DISTINCT segment, CASE WHEN segment % 5 = 2 THEN segment * 10 + 0.5 ELSE segment * 10 - 1.0 END AS committed FROM records WHERE segment % 7 <> 6),
t AS (SELECT segment, min(ts) AS start, max(ts) AS stop FROM records GROUP BY 1),
x AS (SELECT t.segment, start, stop, committed, lag(stop) OVER (ORDER BY t.segment) AS stop_before, start - lag(start) OVER (ORDER BY t.segment) AS gap FROM t LEFT JOIN commits USING (segment)),
w AS (SELECT count(*) FILTER (committed > stop_before + 0.05) AS waited, max(gap) AS widest, count(*) AS n FROM x)
{_happy()} UNION ALL {_problem("streaming", "segment", "'no commit time'", "x WHERE committed IS NULL")} UNION ALL
{_problem("streaming", "segment", "'consumed before its commit'", "x WHERE committed > start + 0.05")} UNION ALL
{_problem("streaming", "n", "'readers never waited for the producer'", "w WHERE waited = 0")} UNION ALL
{_problem("streaming", "n", "'segments start closer than the producer''s pace'", "w WHERE widest < 11")}""")
def check_streaming(spark, sf):
    records = faulty(spark, sf)
    when = F.when(F.col("segment") % 5 == 2, F.col("segment") * 10 + 0.5).otherwise(F.col("segment") * 10 - 1.0).cast("double")
    commits = records.where("segment % 7 <> 6").select("segment", when.alias("committed")).distinct()
    return checks.streaming(records, SEGMENT_BLOCKS, commits, 11.0)


@query(f"WITH {_plan(2)} SELECT DISTINCT 'blocks/' || block_id || '.parquet' AS locator FROM plan WHERE seq < 9 AND block_id NOT IN (SELECT block_id FROM plan WHERE seq >= 9)")
def gc_candidates(spark, sf):
    from .sources.log import unreferenced

    return unreferenced(plan(spark, sf, 2).withColumn("locator", F.concat(F.lit("blocks/"), "block_id", F.lit(".parquet"))), 9)


@query(f"""WITH {_plan()}, kept AS (SELECT seq, block_id AS locator FROM plan WHERE seq >= 4 AND seq <> 6), files AS (SELECT block_id AS locator FROM plan WHERE seq >= 4 AND seq <> 6 AND pos <> 3 UNION ALL SELECT 'stray'),
b AS (SELECT min(seq) AS first, max(seq) AS last, count(DISTINCT seq) AS n FROM kept)
{_problem("retention", "n", "'no segments left in the log'", "b WHERE n = 0")} UNION ALL {_problem("retention", "first", "'the window should start at 3'", "b WHERE first <> 3")} UNION ALL {_problem("retention", "n", "'the window has a hole'", "b WHERE last - first + 1 <> n")} UNION ALL
{_problem("retention", "NULL", "'missing ' || locator", "(SELECT DISTINCT locator FROM kept) k ANTI JOIN files USING (locator)")} UNION ALL
{_problem("retention", "NULL", "'orphan ' || locator", "files ANTI JOIN kept USING (locator) WHERE (SELECT n FROM b) > 0")}""")
def check_retention(spark, sf):
    kept = plan(spark, sf).where("seq >= 4 and seq <> 6").select("seq", "pos", F.col("block_id").alias("locator"))
    files = kept.where("pos <> 3").select("locator").unionByName(spark.createDataFrame([("stray",)], "locator string"))
    return checks.retention(kept.drop("pos"), files, 5, 2)


@query(f"""WITH {_plan()}, {_trail(name="good")},
records AS (SELECT * REPLACE (CASE WHEN segment % 7 = 6 AND position % 12 = 0 THEN (SELECT block_id FROM plan WHERE position = 0) ELSE block_id END AS block_id) FROM good),
used AS (SELECT segment, min(ts) AS first_ts, list_sort(list_distinct(list(block_id))) AS ids FROM records GROUP BY 1), e AS (SELECT segment + 1 AS segment, max(ts) AS end0 FROM records WHERE rank = 0 GROUP BY 1),
log AS (SELECT seq AS segment, CASE WHEN seq % 6 = 5 THEN 'batch' ELSE 'remine' END AS writer, CASE WHEN seq % 4 = 3 THEN seq * 10 - 6.9 WHEN seq % 4 = 1 THEN seq * 10 + 0.5 ELSE seq * 10 - 0.5 END AS created,
  list_sort(list_distinct(list(CASE WHEN seq % 5 = 4 AND pos = 1 THEN 'zzz' ELSE block_id END))) AS own FROM plan WHERE seq <> 8 GROUP BY seq),
r AS (SELECT * FROM used LEFT JOIN log USING (segment) LEFT JOIN e USING (segment))
{_happy()} UNION ALL {_problem("hook", "segment", "'consumed but not in the log'", "r WHERE writer IS NULL")} UNION ALL
{_problem("hook", "segment", "'not written by the hook after the segment before'", "r WHERE segment >= 2 AND writer <> 'remine'")} UNION ALL
{_problem("hook", "segment", "'committed after its first use'", "r WHERE segment >= 2 AND created > first_ts + 0.05")} UNION ALL
{_problem("hook", "segment", "'committed before the segment before was done'", "r WHERE segment >= 2 AND created <= first_ts + 0.05 AND created + 0.05 < end0")} UNION ALL
{_problem("hook", "segment", "'consumed other blocks than its own'", "r WHERE segment >= 2 AND ids <> own")} UNION ALL
{_problem("hook", "segment", "'re-used blocks of the base corpus'", "(SELECT DISTINCT segment FROM records WHERE segment >= 2 AND block_id IN (SELECT block_id FROM plan WHERE seq < 2))")}""")
def check_hook_provenance(spark, sf):
    """Faults of every kind: a segment that the log lacks, another writer, commits too early and too late, other blocks, blocks of the base corpus."""
    rows = stored(plan(spark, sf), "plan")
    own = F.when((F.col("seq") % 5 == 4) & (F.col("pos") == 1), "zzz").otherwise(F.col("block_id")).alias("block_id")
    blocks = F.sort_array(F.collect_list(F.struct("pos", own)))
    created = F.when(F.col("seq") % 4 == 3, F.col("seq") * 10 - 6.9).when(F.col("seq") % 4 == 1, F.col("seq") * 10 + 0.5).otherwise(F.col("seq") * 10 - 0.5)
    writer = F.when(F.col("seq") % 6 == 5, F.lit("batch")).otherwise(F.lit("remine"))
    meta = F.create_map(F.lit("writer"), writer, F.lit("mined_after_segment"), (F.col("seq") - 1).cast("string"), F.lit("created_at"), created.cast("string"))
    segments = rows.where("seq <> 8").groupBy("seq").agg(blocks.alias("blocks")).withColumn("meta", meta)
    first = rows.where("position = 0").select(F.col("block_id").alias("first"))
    wrong = (F.col("segment") % 7 == 6) & (F.col("position") % SEGMENT_BLOCKS == 0)
    records = trail(rows, RANKS).join(F.broadcast(first), F.lit(True), "left").withColumn("block_id", F.when(wrong, F.col("first")).otherwise(F.col("block_id"))).drop("first")  # one row
    return checks.hook_provenance(records, segments, SEGMENT_BLOCKS, 2)


# ---- vectors ----

_CENT = """dims AS (SELECT label::BIGINT AS cluster, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
cent AS (SELECT cluster, dim, avg(x) AS value FROM dims GROUP BY 1, 2)"""
_NEAR = f"""{_CENT},
dist AS (SELECT a.cluster, b.cluster AS near, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS distance FROM cent a JOIN cent b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY 1, 2),
near AS (SELECT cluster, near, distance, j FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, near) - 1 AS j FROM dist) WHERE j < 3)"""
_RING = """ring AS (
  SELECT label::BIGINT AS cluster, vec_id AS item, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY label) AS size, coalesce(lead(vec_id) OVER w, first_value(vec_id) OVER w) AS nxt
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id)
)"""


@query(f"WITH {_CENT} SELECT cluster, dim::INTEGER AS dim, round(value, 6) AS value FROM cent")
def centroids(spark, sf):
    return mining.centroids(table(spark, sf, "embeddings")).select("cluster", "dim", F.round("value", 6).alias("value"))


@query(f"WITH {_NEAR} SELECT cluster, j, near, round(distance, 6) AS distance FROM near")
def hard_negative_clusters(spark, sf):
    return mining.near_clusters(mining.centroid_vectors(table(spark, sf, "embeddings")), 3).select("cluster", "j", "near", F.round("distance", 6).alias("distance"))


@query(f"WITH {_RING} SELECT item, nxt AS positive FROM ring")
def mine_positives(spark, sf):
    return mining.positives(table(spark, sf, "embeddings"), SEED)


@query(f"""WITH {_NEAR}, {_RING} SELECT r.item, n.j, m.item AS negative FROM ring r JOIN near n ON r.cluster = n.cluster
JOIN (SELECT cluster, max(size) AS size FROM ring GROUP BY 1) s ON s.cluster = n.near JOIN ring m ON m.cluster = n.near AND m.place = r.place % s.size""")
def mine_negatives(spark, sf):
    items = table(spark, sf, "embeddings")
    return mining.negatives(items, mining.near_clusters(mining.centroid_vectors(items), 3), SEED)


_KNN = """q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS "query", q.label::BIGINT AS query_label, b.vec_id AS item, b.label::BIGINT AS label, list_dot_product(q.v, b.v) AS sim FROM q, b WHERE q.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY sim DESC, item) AS rank FROM s),
votes AS (SELECT "query", query_label, label, sum(exp(sim / 0.1)) AS weight FROM nn WHERE rank <= 10 GROUP BY 1, 2, 3),
pred AS (SELECT "query", query_label, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY weight DESC, label) AS r FROM votes) WHERE r = 1)"""


def _split(spark, sf):
    """Every row whose id is divisible by 100, against all rows; only the query itself is left out."""
    items = table(spark, sf, "embeddings")
    return items.where("vec_id % 100 = 0"), items


@query(f'WITH {_KNN} SELECT "query", item, round(sim, 6) AS sim, rank::INTEGER AS rank FROM nn WHERE rank <= 10')
def knn_neighbours(spark, sf):
    return probe.neighbours(*_split(spark, sf), 10, itself=False).select("query", "item", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {_KNN} SELECT * FROM pred")
def knn_vote(spark, sf):
    return probe.vote(probe.neighbours(*_split(spark, sf), 10, itself=False), 0.1)


@query(f"WITH {_KNN} SELECT count(*) AS queries, avg((query_label = predicted)::INTEGER::DOUBLE) AS accuracy FROM pred")
def knn_accuracy(spark, sf):
    return probe.accuracy(*_split(spark, sf), 10, 0.1, 10, itself=False)


@query(f"""WITH {_RING}, v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT item // 32 AS block, item, a.v AS a, q.v AS p FROM ring JOIN v a ON a.vec_id = item JOIN v q ON q.vec_id = nxt),
l AS (SELECT x.block, x.item, list_dot_product(x.a, x.p) / 0.1 AS pos, list_dot_product(x.a, y.p) / 0.1 AS neg FROM p x JOIN p y ON x.block = y.block AND x.item <> y.item),
r AS (SELECT block, item, ln(exp(max(pos)) + sum(exp(neg))) - max(pos) AS loss FROM l GROUP BY 1, 2)
SELECT block, round(avg(loss), 5) AS loss, count(*) AS anchors FROM r GROUP BY 1""")
def info_nce_loss(spark, sf):
    items = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    pairs = mining.positives(items, SEED)
    block = planner.div(F.col("item"), 32)
    vec = items.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = pairs.join(vec, F.col("item") == F.col("id")).select("item", "positive", F.col("v").alias("anchor"))
    rows = rows.join(vec, F.col("positive") == F.col("id")).select(block.alias("block"), "item", "anchor", F.col("v").alias("positive"))
    return mining.info_nce(rows, rows.select("block", "item", F.col("positive").alias("candidate")), 0.1).select("block", F.round("loss", 5).alias("loss"), "anchors")


# ---- training ----

_X = "l_quantity / 50 AS x_0, l_discount * 10 AS x_1, l_tax * 10 AS x_2, l_extendedprice / 10000 AS y"
_WEIGHTS = [0.5, 0.1, 0.1]
_GRAD = "avg(o * o) AS loss, 2 * avg(o * x_0) AS g0, 2 * avg(o * x_1) AS g1, 2 * avg(o * x_2) AS g2"


def features(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.select(
        block_number().alias("block"), (F.col("l_quantity") / 50).alias("x_0"), (F.col("l_discount") * 10).alias("x_1"), (F.col("l_tax") * 10).alias("x_2"), (F.col("l_extendedprice") / 10000).alias("y")
    ).withColumn("rank", F.col("block") % RANKS)


def _off(by: str) -> str:
    return f"f AS (SELECT l_orderkey // 100 AS block, (l_orderkey // 100) % 3 AS rank, {_X} FROM lineitem), o AS (SELECT *, x_0 * 0.5 + x_1 * 0.1 + x_2 * 0.1 - y AS o FROM f), g AS (SELECT {by}, {_GRAD} FROM o GROUP BY 1)"


@query(f"WITH {_off('block')} SELECT block, round(loss, 6) AS loss, round(g0, 6) AS grad_0, round(g1, 6) AS grad_1, round(g2, 6) AS grad_2 FROM g")
def linreg_step(spark, sf):
    out = train.linear_sums(features(spark, sf), ["block"], ["x_0", "x_1", "x_2"], "y", _WEIGHTS)
    return out.select("block", *[F.round(c, 6).alias(c) for c in ("loss", "grad_0", "grad_1", "grad_2")])


def _replicas(spark, sf) -> DataFrame:
    """(rank, dim, value): each rank's weights after one step on its blocks."""
    g = train.linear_sums(features(spark, sf), ["rank"], ["x_0", "x_1", "x_2"], "y", _WEIGHTS)
    stepped = F.array(*[F.lit(w) - 0.05 * F.col(f"grad_{i}") for i, w in enumerate(_WEIGHTS)])
    return g.select("rank", F.posexplode(stepped).alias("dim", "value"))


_REPLICAS = f"{_off('rank')}, p AS (SELECT rank, unnest([0, 1, 2]) AS dim, unnest([0.5 - 0.05 * g0, 0.1 - 0.05 * g1, 0.1 - 0.05 * g2]) AS value FROM g)"


def _parameters(spark, sf) -> list:
    """The ranks' parameters as the training loop holds them: one vector each."""
    found = sorted((r["rank"], r["dim"], r["value"]) for r in _replicas(spark, sf).collect())  # a row a rank and weight
    return [[np.array([v for rank, _, v in found if rank == k])] for k in sorted({r for r, _, _ in found})]


@query(f"WITH {_REPLICAS} SELECT dim::INTEGER AS dim, round(avg(value), 6) AS value FROM p GROUP BY 1")
def local_sgd_avg(spark, sf):
    mean = train.build_sync("local_sgd", [np.array(_WEIGHTS)]).agree(_parameters(spark, sf))[0]
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(mean)], "dim int, value double")


@query(f"""WITH {_REPLICAS}, c AS (SELECT dim, [0.5, 0.1, 0.1][dim + 1]::DOUBLE AS a, avg(value) AS m FROM p GROUP BY dim), h AS (SELECT dim, a, a - m AS change FROM c),
s AS (SELECT 1 AS step, dim, a - 0.7 * (1.9 * change) AS anchor, change AS velocity FROM h UNION ALL SELECT 2, dim, a - 0.7 * (1.9 * change) - 0.7 * (change + 0.9 * (1.9 * change)), 1.9 * change FROM h)
SELECT step, dim::INTEGER AS dim, round(anchor, 6) AS anchor, round(velocity, 6) AS velocity FROM s""")
def diloco_outer(spark, sf):
    """Two outer steps with the same change of every replica, the state saved and restored between them."""
    change = [[p - np.array(_WEIGHTS) for p in replica] for replica in _parameters(spark, sf)]
    sync, rows = train.build_sync("diloco", [np.array(_WEIGHTS)], 0.7, 0.9), []
    for step in (1, 2):
        anchor = sync.agree([[a + c for a, c in zip(sync.anchor, replica)] for replica in change])
        rows += [(step, i, round(float(a), 6), round(float(v), 6)) for i, (a, v) in enumerate(zip(anchor[0], sync.velocity[0]))]
        state, sync = sync.state(), train.build_sync("diloco", [np.zeros(3)], 0.7, 0.9)
        sync.restore(state)
    return spark.createDataFrame(rows, "step int, dim int, anchor double, velocity double")


# ---- streams and stores ----


@query("""WITH e AS (SELECT event_id // 32 AS seq, event_id % 32 AS slot, event_id FROM events)
SELECT seq, slot, event_id FROM e WHERE seq IN (SELECT seq FROM e GROUP BY 1 HAVING count(*) = 32)""")
def stream_segments(spark, sf):
    return stream_writer.windows(table(spark, sf, "events").select("event_id"), 32, "event_id").select("seq", "slot", "event_id")


@query()
def stream_segments_buffered(spark, sf):
    """Segments of 32 drawn from a buffer of 64, by a stateful streaming query over the events' files."""
    folder = shared_folder(spark, "stream")
    schema = T.StructType([T.StructField("event_id", T.LongType())])
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    blocks = source.select("event_id", F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("block_id"))
    out = stream_writer.segments_of(blocks, 32, 2, SEED, "event_id")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq long, slot long, block_id string").parquet(f"{folder}/out")


@query("SELECT doc_id, source, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def bank_prefix(spark, sf):
    """The first 100 rows in log order, where blocks are ranges of ids."""
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").orderBy("doc_id").limit(100)


@query(f"WITH {_FAULTY} SELECT attempt::BIGINT AS attempt, rank, world_size::BIGINT AS world_size, segment, step, position, block_id, ts FROM records")
def audit_roundtrip(spark, sf):
    """A trail written as JSON lines, a file a rank, and read back in file order."""
    from .sources.audit import read_audit, write_audit
    from .sources.storage import Store

    store = Store.at(shared_folder(spark, "audit"))
    write_audit(faulty(spark, sf), store, "run")
    return read_audit(spark, store, "run").drop("part", "line")


@query("SELECT l_orderkey, l_linenumber, 'b' || lpad(CAST(l_orderkey // 100 AS VARCHAR), 5, '0') AS block_id FROM lineitem")
def log_roundtrip(spark, sf):
    """All blocks written one a file, committed as segments, read back through the manifest.

    The last segment is filled from the head of the order; a block that stands twice is read where it stands first.
    """
    from .operators.writers import write_batch
    from .sources.blocks import read_blocks, write_blocks
    from .sources.log import BlockLog, Ref
    from .sources.storage import Store

    store = Store.at(shared_folder(spark, "log"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("b"), F.lpad(block_number().cast("string"), 5, "0")).alias("block_id"))
    refs = [Ref(*r) for r in write_blocks(rows, store).collect()]  # a small row a block
    log = BlockLog.create(store, SEGMENT_BLOCKS, SEED)
    write_batch(log, sorted(refs, key=lambda r: r.block_id), tail="wrap", spark=spark)
    places = log.manifest(spark).groupBy("block_id").agg(F.min(F.struct("position", "seq", "pos", "locator")).alias("p")).select("block_id", "p.*")
    return read_blocks(spark, store, places).select("l_orderkey", "l_linenumber", "block_id")


from . import catalog_store  # noqa: E402, F401  adds its queries
