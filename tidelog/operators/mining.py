"""Vector mining: centroids, near clusters, positives and hard negatives, contrastive losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.nearest import nearest, sided
from ..functions.numbering import digest_key, digest_ring
from ..functions.vectors import dot, doubles, norm

#: Where the centroid of a cluster without items is put: far from all others.
PARKED = 1e6


def centroids(items: DataFrame, cluster: str = "label", vector: str = "embedding") -> DataFrame:
    """(cluster, dim, value) as a mean for each cluster and dimension, folded before the shuffle."""
    rows = items.select(F.col(cluster).cast("long").alias("cluster"), F.posexplode(doubles(vector)).alias("dim", "x"))
    return rows.groupBy("cluster", "dim").agg(F.avg("x").alias("value"))


def centroid_vectors(items: DataFrame, cluster: str = "label", vector: str = "embedding", clusters: int | None = None, dim: int | None = None) -> DataFrame:
    """(cluster, centroid); with a number of clusters, absent ones are parked."""
    rows = centroids(items, cluster, vector).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("centroid"))
    if clusters is None:
        return rows
    every = items.sparkSession.range(clusters).select(F.col("id").alias("cluster"))
    return every.join(rows, "cluster", "left").withColumn("centroid", F.coalesce("centroid", F.array_repeat(F.lit(PARKED), dim or 1)))


def near_clusters(vectors: DataFrame, k: int) -> DataFrame:
    """(cluster, j, near, distance): the k nearest other clusters, ties by number."""
    rows = sided(vectors, "cluster", F.lit(0), "centroid")
    found = nearest(rows, rows, k, distance=True, itself=False)
    return found.select(F.col("query").alias("cluster"), (F.col("rank").cast("long") - 1).alias("j"), F.col("item").alias("near"), F.col("score").alias("distance"))


def _ring(items: DataFrame, seed: int, item: str, cluster: str) -> DataFrame:
    """Items of each cluster on a hash-ordered ring: (cluster, item, size, at, next). A large cluster is spread by ranges of the hash."""
    rows = items.select(F.col(cluster).cast("long").alias("cluster"), F.col(item).cast("long").alias("item"))
    return digest_ring(rows, ["cluster"], "item", digest_key(seed, F.col("item")))


def positives(items: DataFrame, seed: int, item: str = "vec_id", cluster: str = "label") -> DataFrame:
    """(item, positive): another item of the cluster, the next on its ring; a single item is its own."""
    return _ring(items, seed, item, cluster).select("item", F.col("next").alias("positive"))


def negatives(items: DataFrame, near: DataFrame, seed: int, item: str = "vec_id", cluster: str = "label") -> DataFrame:
    """(item, j, negative): one item of each near cluster, chosen by the anchor's place; from an empty one, the least item of another cluster, else any."""
    ring = _ring(items, seed, item, cluster)
    members = ring.select(F.col("cluster").alias("near"), F.col("at").alias("m_at"), F.col("item").alias("negative"), "size")
    sizes = members.select("near", "size").distinct()
    picks = ring.select("cluster", "item", "at").join(near.select("cluster", "j", "near"), "cluster").join(sizes, "near", "left")
    picks = picks.withColumn("m_at", F.col("at") % F.col("size"))
    found = picks.join(members.drop("size"), ["near", "m_at"], "left")
    least = ring.groupBy("cluster").agg(F.min("item").alias("low")).orderBy("low", "cluster").limit(2)  # the least item outside a cluster is one of these two
    two = least.agg(F.sort_array(F.collect_list(F.struct("low", "cluster"))).alias("two"))
    head, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    spare = F.when(head["cluster"] != F.col("cluster"), head["low"]).otherwise(second["low"])
    return found.join(F.broadcast(two), F.lit(True)).select("item", "j", F.coalesce("negative", spare, "item").alias("negative"))  # one row is broadcast


def training_rows(items: DataFrame, near: DataFrame, k: int, seed: int, item: str = "vec_id", cluster: str = "label", vector: str = "embedding") -> DataFrame:
    """(item, cluster, anchor, positive, neg_0 .. neg_{k-1}) with vectors."""
    vec = items.select(F.col(item).cast("long").alias("id"), F.col(vector).alias("v"))
    out = items.select(F.col(item).cast("long").alias("item"), F.col(cluster).cast("long").alias("cluster"), F.col(vector).alias("anchor"))
    out = out.join(positives(items, seed, item, cluster).join(vec, F.col("positive") == F.col("id")).select("item", F.col("v").alias("positive")), "item")
    neg = negatives(items, near, seed, item, cluster).join(vec, F.col("negative") == F.col("id"))
    wide = neg.groupBy("item").pivot("j", list(range(k))).agg(F.first("v"))
    return out.join(wide.select("item", *[F.col(str(j)).alias(f"neg_{j}") for j in range(k)]), "item")


def info_nce(pairs: DataFrame, pool: DataFrame, temperature: float) -> DataFrame:
    """Mean loss of each block: pairs (block, item, anchor, positive) against the block's pool (block, item, candidate), its own item left out."""
    a = pairs.select("block", "item", doubles("anchor").alias("a"), doubles("positive").alias("p")).withColumn("pos", dot(F.col("a"), F.col("p")) / temperature)
    c = pool.select("block", F.col("item").alias("other"), doubles("candidate").alias("c"))
    logits = a.join(c, "block").where("item <> other").select("block", "item", "pos", (dot(F.col("a"), F.col("c")) / temperature).alias("x"))
    top = logits.groupBy("block", "item").agg(F.max("pos").alias("pos"), F.greatest(F.max("x"), F.max("pos")).alias("m"), F.collect_list("x").alias("xs"))
    total = F.aggregate("xs", F.exp(F.col("pos") - F.col("m")), lambda s, x: s + F.exp(x - F.col("m")))
    return top.select("block", (F.col("m") + F.log(total) - F.col("pos")).alias("loss")).groupBy("block").agg(F.avg("loss").alias("loss"), F.count("*").alias("anchors"))


def nt_xent(views: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Mean symmetric loss of each block over two views (block, item, first, second): each direction's negatives are the other items' positives."""

    def one_way(anchor: str, positive: str) -> DataFrame:
        pairs = views.select("block", "item", F.col(anchor).alias("anchor"), F.col(positive).alias("positive"))
        return info_nce(pairs, pairs.select("block", "item", F.col("positive").alias("candidate")), temperature)

    both = one_way("first", "second").unionByName(one_way("second", "first"))
    return both.groupBy("block").agg(F.avg("loss").alias("loss"), F.max("anchors").alias("anchors"))


def seeded_subset(items: DataFrame, n: int, seed: int, item: str = "vec_id") -> DataFrame:
    """n of the items by the order of a seeded digest, the same ones wherever it is asked."""
    return items.orderBy(digest_key(seed, F.col(item)), item).limit(n)


def unit(items: DataFrame, vector: str) -> DataFrame:
    length = norm(doubles(vector))
    return items.withColumn(vector, F.when(length > 0, F.transform(doubles(vector), lambda x: x / length)).otherwise(doubles(vector)))
