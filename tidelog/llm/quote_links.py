"""Quotation linking (DataFrame functions only).

A message's lines carry a quote level, the number of leading ``>`` marks. Runs of one level are passages.
Quoted passages are normalised (lower case, single blanks) and hashed, whole and line by line, and joined
to the messages whose own text has that passage or line: first within the conversation, then anywhere.
Messages are then put in reply order with the quotes, and the lines that announce them, taken out.

Parsing is row-local. Originals are folded to the earliest message of each hash before the join, so a passage
that a third of all messages share is one row there and a skewed key on the quoting side at most; originals
that nobody quotes are dropped before. Order within a conversation comes from a range partitioning by (conversation,
turn): ranks and predecessors within a range, then across the ranges of a conversation, so a conversation
may be of any length.

Defined cases: null text is empty and has no passage; a null conversation is one conversation; a null turn comes
before all others; rows that share conversation and turn share position and reply; an earlier message is one with a
smaller turn, or in another conversation any; of several originals the message's own conversation comes first, then the
least conversation and turn; passages without a word are never linked; an empty table gives an empty result; all columns
of the input are kept, whatever their names: an output whose name is taken gets underscores appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, free_name, join_checked, parallelism, staged
from .line_quality import let

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
QUOTED = r"(?m)^[ \t]*>"
#: Lines that announce a quote, in four languages.
ANNOUNCES = r"(?i)^[ \t]*(?:on .{1,300} wrote|am .{1,300} schrieb.{0,100}|le .{1,300} a écrit|el .{1,300} escribió)[ \t]*:[ \t\r]*$"


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def fingerprint(text: Column) -> Column:
    return F.md5(normal(text))


def passages(text: Column) -> Column:
    """Runs of lines of one level, in order: array of (level, body)."""
    kind = "array<struct<level:int,body:string>>"

    def runs(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (F.get(rows, i)["level"] != F.get(rows, F.greatest(i - 1, F.lit(0)))["level"]))

        def cut(at: Column) -> Column:
            end = lambda k: F.coalesce(F.get(at, k + 1), F.size(rows))
            return F.transform(at, lambda s, k: F.struct(
                F.get(rows, s)["level"].alias("level"),
                F.array_join(F.transform(F.slice(rows, s + 1, end(k) - s), lambda x: x["body"]), "\n").alias("body"),
            ))

        return let(starts, cut)

    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))
    line = lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))
    parsed = let(F.transform(F.split(text, "\n", -1), line), runs)
    return F.when(text.rlike(QUOTED), parsed).otherwise(F.array(F.struct(F.lit(0).alias("level"), text.alias("body")))).cast(kind)


def own_text(parts: Column) -> Column:
    """The text without quotes and without the lines that announce them."""
    kept = F.filter(parts, lambda p: p["level"] == 0)
    joined = F.array_join(F.transform(kept, lambda p: p["body"]), "\n")
    lines = F.filter(F.split(joined, "\n", -1), lambda x: ~x.rlike(ANNOUNCES))
    return F.when(F.size(kept) == F.size(parts), joined).otherwise(F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")))


def with_word(texts: Column) -> Column:
    return F.filter(texts, lambda x: x.rlike(WORD))


def hashes(texts: Column) -> Column:
    return F.array_distinct(F.transform(with_word(texts), fingerprint))


def order(messages: DataFrame) -> DataFrame:
    """(conv, turn, position, previous turn) of each distinct pair, with no conversation in one task."""
    n = parallelism(messages.sparkSession)
    pairs = messages.select("conv", "turn").distinct().repartitionByRange(n, F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first())
    pairs = staged(pairs.withColumn("part", F.spark_partition_id()), "quote-turns")
    inside = W.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first())
    pairs = pairs.withColumn("rank", F.row_number().over(inside)).withColumn("before", F.lag(F.struct("turn")).over(inside))
    parts = pairs.groupBy("conv", "part").agg(F.count("*").alias("n"), F.max(F.struct("turn")).alias("top"))
    across = W.partitionBy("conv").orderBy("part")
    parts = parts.select(
        "conv", F.col("part").alias("p"), F.coalesce(F.sum("n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lag("top").over(across).alias("top_before"),
    ).withColumnRenamed("conv", "c")
    found = pairs.join(parts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return found.select("conv", "turn", (F.col("base") + F.col("rank")).cast("long").alias("position"), F.coalesce("before", "top_before")["turn"].alias("previous"))


def link(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages with own_text, passages, position, reply_turn, quoted_conv, quoted_turn, n_quoted, n_linked, deepest.

    reply_turn: the latest message of the conversation whose passage is quoted at the first level, else the
    message before. quoted_conv and quoted_turn: the original of the first linked passage, wherever it is.
    """
    quoted_name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # the message's own columns travel in one struct, so that no name of theirs meets one of ours
    rows = messages.select(
        F.struct(*map(quoted_name, messages.columns)).alias("m"), quoted_name(conv_id).cast("long").alias("conv"), quoted_name(turn).cast("long").alias("at"),
        F.coalesce(quoted_name(text).cast("string"), F.lit("")).alias("body"),
    )
    rows = rows.withColumn("tie", F.xxhash64("body")).withColumn("passages", passages(F.col("body"))).drop("body")
    rows = rows.withColumn("own_text", own_text(F.col("passages")))
    quoted = F.filter("passages", lambda p: (p["level"] > 0) & p["body"].rlike(WORD))
    # quoted passages of distinct messages, with the hashes by which each may be found
    quoting = rows.where(F.exists("passages", lambda p: p["level"] > 0)).select("conv", "at", "tie", quoted.alias("q")).dropDuplicates(["conv", "at", "tie"])
    quoting = quoting.select("conv", "at", "tie", F.posexplode("q").alias("k", "p"))
    lines = F.transform(hashes(F.split("p.body", "\n", -1)), lambda h: F.struct(h.alias("h"), F.lit(1).alias("part")))
    keys = F.concat(F.array(F.struct(fingerprint(F.col("p.body")).alias("h"), F.lit(0).alias("part"))), lines)
    asked = staged(quoting.select("conv", "at", "tie", "k", F.col("p.level").alias("level"), F.explode(keys).alias("key")).select("*", "key.h", "key.part").drop("key"), "quotes")
    # originals: each message's own text, whole and by line, only hashes that somebody quotes, folded to the earliest message
    own = rows.select("conv", "at", F.explode(hashes(F.concat(F.array("own_text"), F.split("own_text", "\n", -1)))).alias("h"))
    own = join_checked(own, staged(asked.select("h").distinct(), "quoted-hashes"), ["h"], "left_semi")
    # turns are compared within structs, where null is the least
    here = staged(own.groupBy("h", "conv").agg(F.min(F.struct(F.col("at").alias("t"))).alias("there")), "originals")
    # and the least originals of the two least conversations of each hash: one of them isn't the asking conversation
    original = F.struct(F.col("conv").alias("c"), F.col("there.t").alias("t"))
    first = staged(here.groupBy("h").agg(F.min(original).alias("first")), "first-originals")
    rest = join_checked(here, first, ["h"], "inner").where(~F.col("conv").eqNullSafe(F.col("first.c")))
    anywhere = first.join(rest.groupBy("h").agg(F.min(original).alias("second")), "h", "left")
    near = here.select("h", F.col("conv").alias("c"), "there")
    earlier = (near["there.t"] < asked["at"]) | (near["there.t"].isNull() & asked["at"].isNotNull())
    found = asked.join(near, (asked["h"] == near["h"]) & asked["conv"].eqNullSafe(near["c"]) & earlier, "left").drop(near["h"]).drop("c")
    found = found.join(anywhere, "h", "left")
    found = found.withColumn("other", F.when(F.col("first.c").eqNullSafe(F.col("conv")), F.col("second")).otherwise(F.col("first")))
    choice = F.when(F.col("there").isNotNull(), F.struct(F.col("part").alias("rank"), F.col("conv").alias("c"), F.col("there.t").alias("t"))).when(
        F.col("other").isNotNull(), F.struct((F.col("part") + 2).alias("rank"), F.col("other.c").alias("c"), F.col("other.t").alias("t"))
    )
    linked = found.groupBy("conv", "at", "tie", "k").agg(F.min(choice).alias("to"), F.first("level").alias("level"))
    replies = staged(
        linked.groupBy("conv", "at", "tie").agg(
            F.count("to").alias("n_linked"),
            F.max(F.when((F.col("level") == 1) & (F.col("to.rank") < 2), F.struct("to.t"))).alias("answers"),
            F.min(F.when(F.col("to").isNotNull(), F.struct("k", "to.c", "to.t"))).alias("source"),
        ),
        "replies",
    )
    ranks = order(rows.select("conv", F.col("at").alias("turn"))).select(
        F.coalesce("conv", F.lit(0)).alias("conv_"), F.col("conv").isNull().alias("conv_null"), F.coalesce("turn", F.lit(0)).alias("at_"), F.col("turn").isNull().alias("at_null"), "position", "previous"
    )
    keys = {"conv_": F.coalesce("conv", F.lit(0)), "conv_null": F.col("conv").isNull(), "at_": F.coalesce("at", F.lit(0)), "at_null": F.col("at").isNull()}
    rows = rows.withColumns(keys).join(ranks, list(keys), "left")
    replies = replies.withColumns(keys).drop("conv", "at")
    rows = join_checked(rows, replies, [*keys, "tie"], "left")
    made = {
        "own_text": F.col("own_text"), "passages": F.col("passages"), "position": F.col("position"),
        "reply_turn": F.when(F.col("answers").isNotNull(), F.col("answers.t")).otherwise(F.col("previous")), "quoted_conv": F.col("source.c"), "quoted_turn": F.col("source.t"),
        "n_quoted": F.size(quoted).cast("long"), "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "deepest": F.array_max(F.transform("passages", lambda p: p["level"])).cast("long"),
    }
    return rows.select("m.*", *[value.alias(free_name(messages, name)) for name, value in made.items()])


def op3(spark, sf_dir: str) -> DataFrame:
    """Every message of conversations, linked and in reply order."""
    found = link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select(
        "conv_id", "turn", "role", "position", "reply_turn", "quoted_conv", "quoted_turn", "n_quoted", "n_linked", "deepest", F.sha2("own_text", 256).alias("own_sha256")
    )


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    normal_sql = lambda x: f"lower(trim(regexp_replace({x}, '[\\x20\\x09-\\x0D]+', ' ', 'g')))"
    has_word = lambda x: f"regexp_matches({x}, {quoted(WORD)})"
    return f"""
WITH m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
l AS (SELECT rid, generate_subscripts(s, 1) AS k, unnest(s) AS line FROM (SELECT rid, string_split(t, chr(10)) AS s FROM m)),
v AS (SELECT rid, k, length(regexp_replace(regexp_extract(line, {quoted(MARKS)}, 1), '[^>]', '', 'g')) AS level, regexp_replace(line, {quoted(MARKS)}, '') AS body FROM l),
e AS (SELECT *, coalesce(level <> lag(level) OVER w, true)::INTEGER AS begins FROM v WINDOW w AS (PARTITION BY rid ORDER BY k)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY rid ORDER BY k) AS p FROM e),
parts AS (SELECT rid, p, min(level) AS level, string_agg(body, chr(10) ORDER BY k) AS body FROM g GROUP BY 1, 2),
facts AS (SELECT rid, max(level) AS deepest, count(*) FILTER (level > 0 AND {has_word("body")}) AS n_quoted FROM parts GROUP BY 1),
own AS (
  SELECT m.rid, CASE WHEN deepest = 0 THEN t ELSE coalesce(trim((SELECT string_agg(body, chr(10) ORDER BY k) FROM v WHERE v.rid = m.rid AND level = 0 AND NOT regexp_matches(body, {quoted(ANNOUNCES)})), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') END AS own
  FROM m JOIN facts USING (rid)
),
source AS (
  SELECT DISTINCT conv_id, turn, md5({normal_sql("x")}) AS h FROM (
    SELECT conv_id, turn, own AS x FROM m JOIN own USING (rid) UNION ALL SELECT conv_id, turn, unnest(string_split(own, chr(10))) AS x FROM m JOIN own USING (rid)) WHERE {has_word("x")}
),
q AS (SELECT rid, p, level, body FROM parts WHERE level > 0 AND {has_word("body")}),
asked AS (
  SELECT rid, p, level, 0 AS part, md5({normal_sql("body")}) AS h FROM q UNION ALL
  SELECT rid, p, level, 1 AS part, md5({normal_sql("x")}) AS h FROM (SELECT rid, p, level, unnest(string_split(body, chr(10))) AS x FROM q) WHERE {has_word("x")}
),
near AS (
  SELECT a.rid, a.p, a.level, a.part AS rank, o.conv_id AS c, o.turn AS t FROM asked a JOIN m USING (rid) JOIN source o ON o.h = a.h AND o.conv_id IS NOT DISTINCT FROM m.conv_id
  WHERE o.turn < m.turn OR (o.turn IS NULL AND m.turn IS NOT NULL)
),
far AS (
  SELECT a.rid, a.p, a.level, a.part + 2 AS rank, o.conv_id AS c, o.turn AS t FROM asked a JOIN m USING (rid) JOIN source o ON o.h = a.h AND o.conv_id IS DISTINCT FROM m.conv_id
),
found AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid, p ORDER BY rank, c NULLS FIRST, t NULLS FIRST) AS choice FROM (SELECT * FROM near UNION ALL SELECT * FROM far)) WHERE choice = 1
),
replies AS (
  SELECT rid, count(*) AS n_linked, count(*) FILTER (level = 1 AND rank < 2) AS n_answers, max(t) FILTER (level = 1 AND rank < 2) AS answers,
         min(struct_pack(p := p, c := c)).c AS quoted_conv, min(struct_pack(p := p, t := t)).t AS quoted_turn
  FROM found GROUP BY 1
),
ranks AS (SELECT conv_id, turn, row_number() OVER w AS position, lag(turn) OVER w AS previous FROM (SELECT DISTINCT conv_id, turn FROM m) WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST))
SELECT m.conv_id, m.turn, m.role, position, CASE WHEN n_answers > 0 THEN answers ELSE previous END AS reply_turn, quoted_conv, quoted_turn, n_quoted, coalesce(n_linked, 0) AS n_linked, deepest,
       sha256(own) AS own_sha256
FROM m JOIN facts USING (rid) JOIN own USING (rid) JOIN ranks ON ranks.conv_id IS NOT DISTINCT FROM m.conv_id AND ranks.turn IS NOT DISTINCT FROM m.turn LEFT JOIN replies USING (rid)
"""


ORACLE_OP3 = _oracle()
