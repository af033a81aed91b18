"""Mixing sources to target weights (DataFrame functions only).

Every row gets a hash-random key. Within a source the rows are range-sorted by that key: the key
space is cut in equal ranges, the token counts of each range are summed, and a running sum over the
ranges gives each range's start. A source's rows are taken in key order up to its exact budget; a budget
above the source's size repeats whole epochs. Ranges before the cut are taken whole and those behind it not, so
single rows are sorted only in the range where the budget ends. The result is a row a source with the place of the cut,
and each row's share follows from that and its own key: nothing is joined back to the rows but that small table.

Rows that agree in source, id and text have one key. They are folded to a count before the sort, so that
a hot one is one row there; where the budget ends among them, they are numbered by the tasks that read them.

Defined cases: null text has size 0; null source is a source of its own, ordered last; a source whose
size is 0 takes a weight but gets target 0; rows that repeat are rows like any other (of rows that agree in source, id and
text any may be the ones that are taken); ids may be null or tie; an empty table gives an empty result; extra columns are
ignored by ``mix`` and kept by ``stage``. The table of sources is small: it is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, join_checked, spread, staged, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Water-filling over the table of sources: (source, source_size) -> target.

    Weighted shares are capped at most_epochs times a source's size and the excess is reshared by weight
    until no share is above its cap. That fixed point is target = min(cap, level * weight); the level is
    found from running sums in the order of cap / weight. One row a source, so one small sort.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    whole = W.partitionBy()
    rows = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
    )
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    # the first source whose cap isn't reached sets the level for it and all that follow
    fits = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(whole)
    rows = rows.withColumn("water", fits["level"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    """What places a row: its source (null apart), and the order within it."""
    name, tie = F.col(source).cast("string"), F.xxhash64(text_of(text))
    ident = F.col(doc_id).cast("string")
    return {"have": F.coalesce(name, F.lit("")), "no_source": name.isNull(), "order": F.struct(F.xxhash64(F.lit(seed), ident, tie).alias("key"), ident.alias("id"), tie.alias("tie"))}


def cuts(rows: DataFrame, weights=WEIGHTS, share: float = 1.0, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """rows (have, no_source, order, size) -> a row a source: source_size, target, epochs that all its rows get, and where the rest of the budget ends.

    ``cut`` is the order of the rows at the end (null: the budget is whole epochs), ``alike`` how many they are, ``full`` how many of them
    the rest still takes whole and ``part`` how many words of one more.
    """
    source = ["have", "no_source"]
    sizes = rows.groupBy(*source).agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    named = sizes.withColumn("source", F.when(~F.col("no_source"), F.col("have")))
    goal = targets(named.select("source", "source_size"), weights, share, most_epochs).select(F.coalesce("source", F.lit("")).alias("have"), F.col("source").isNull().alias("no_source"), "target")
    goal = staged(
        sizes.join(goal, source)
        .withColumn("budget", F.floor(F.col("target") + F.lit(0.5)).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.least(F.lit(1 << 31), F.ceil(F.sqrt("source_rows"))).cast("long")),  # as many ranges as rows in one
        "mix-targets",
    )
    # the key's upper 32 bits, scaled: ranges of equal width in key order
    upper = F.shiftright("order.key", 32) + F.lit(1 << 31)
    placed = join_checked(rows, goal.select(*source, "ranges", "rest"), source, "inner").withColumn("range", F.shiftright(upper * F.col("ranges"), 32))
    before = W.partitionBy(*source).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*source, "range").agg(F.sum("size").alias("range_size"), F.first("rest").alias("rest"))
    starts = sums.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    last = staged(starts.where("start < rest and rest <= start + range_size").select(*source, "range", "start"), "mix-ranges")  # a row a source at most
    inside = join_checked(placed, last, [*source, "range"], "inner").groupBy(*source, "order").agg(F.count("*").alias("alike"), F.first("size").alias("size"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    ordered = W.partitionBy(*source).orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("left", F.col("rest") - F.col("start") - F.coalesce(F.sum(F.col("alike") * F.col("size")).over(ordered), F.lit(0)))
    ends = inside.where("0 < left and left <= alike * size").select(
        *source, F.col("order").alias("cut"), "alike", F.expr("left div size").alias("full"), F.expr("left % size").alias("part")
    )
    return staged(goal.select(*source, "source_size", "target", "epochs").join(ends, source, "left"), "mix-cuts")


def share_out(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (have, no_source, order, ...) with the columns of plan, and how often each is taken whole (copies) and how many words once more (part)."""
    source = ["have", "no_source"]
    rows = join_checked(rows, plan, source, "inner")
    here = F.coalesce(F.col("order") == F.col("cut"), F.lit(False))
    earlier = F.coalesce(F.col("order") < F.col("cut"), F.lit(False))

    def given(df: DataFrame, rank: Column) -> DataFrame:
        whole = earlier | (here & (rank < F.col("full")))
        return df.withColumn("copies", F.col("epochs") + whole.cast("long")).withColumn("part", F.when(here & (rank == F.col("full")), F.col("part")).otherwise(F.lit(0)).cast("long"))

    if plan.where("alike > 1").isEmpty():
        return given(rows, F.lit(0))
    several = here & (F.col("alike") > 1)
    # rows that nothing tells apart, numbered by task and, within a task's rows, by their order there
    alike = staged(rows.where(several).withColumn("task", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()), "mix-alike")
    counts = alike.groupBy(*source, "task").agg(F.count("*").alias("n"))
    first = counts.select(*source, "task", F.coalesce(F.sum("n").over(W.partitionBy(*source).orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ranked = alike.join(first, [*source, "task"]).withColumn("rank", F.col("first") + F.row_number().over(W.partitionBy(*source, "task").orderBy("line")) - 1)
    return given(rows.where(~several), F.lit(0)).unionByName(given(ranked, F.col("rank")).drop("task", "line", "first", "rank"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None,
        weights=WEIGHTS, share: float = 1.0, most_epochs: int = MOST_EPOCHS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words, repeats counted), epochs, tie (a hash of the text).

    Of a document at the cut the mix takes as many words as the budget still has.
    """
    count = word_count(text_of(text)) if size is None else size
    place = keyed(docs, doc_id, text, source, seed)
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count.alias("size"), *[c.alias(k) for k, c in place.items()]), "mix")
    out = share_out(rows, cuts(rows, weights, share, most_epochs))
    return out.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        (F.col("copies") + (F.col("part") > 0).cast("long")).alias("epochs"), F.col("order.tie").alias("tie"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents."""
    return mix(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row as often as the mix takes it whole, and the words that it takes of a row at a cut.

    Rows without a word have nothing to take and go.
    """
    place = keyed(docs, "doc_id", "text", "source", 7)
    sized = staged(docs.select(word_count(text_of()).alias("size"), *[c.alias(k) for k, c in place.items()]), "mix")
    rows = docs.where(F.col("text").rlike(WORD)).select(F.struct(*docs.columns).alias("row"), *[c.alias(k) for k, c in place.items()])
    rows = share_out(rows, cuts(sized)).where("copies > 0 or part > 0")
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.when(F.col("part") > 0, F.array(F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), ""))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("taken", F.explode(F.concat(F.array_repeat("row.text", F.col("copies").cast("int")), part)))
    value = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("taken")}
    if "n_chars" in value:
        value["n_chars"] = F.length("taken").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(k) for k, c in value.items()])
