"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``RADIUS`` bits have a common point within half the radius of both. So
every distinct fingerprint emits all its variants within half the radius (1 + 64 + 2016 for two
bits), variants are shuffled, and fingerprints that meet on a variant are verified and linked.

Variants are shuffled by class, the value of a fixed linear (XOR) map of their bits. The map makes
the encoding compact: the variants of f in class c are f ^ m for just those masks m whose image is
image(f) ^ c, so the message to a class is f itself and the class task derives the variants. A
class holds at most ``CLASS_VARIANTS`` variants on average; the number of classes grows with the
number of fingerprints. Rows of one variant are linked to the least fingerprint, never in pairs, and a
class reports a star forest of what it linked. Components of the links are found by ``components``.

Defined cases: null and blank texts have fingerprint 0 and are linked like any other; texts with fewer
words than a shingle hash their whole word sequence; equal fingerprints are one node; repeated rows
share a component; a null id is passed over for component_id unless the component has no other id;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, free_name, ident, join_checked, parallelism, scratch, spread, staged
from .components import LINKS, components, forest, joined

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Variants that one class task sorts, on average, at most.
CLASS_VARIANTS = 1 << 24

_U = np.uint64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - shingle + 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _prints(batches):
    for batch in batches:
        values = [fingerprint(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "tie", "print"])


def masks(half: int) -> np.ndarray:
    """All 64-bit masks of at most that many bits."""
    return np.array([sum(1 << b for b in bits) for k in range(half + 1) for bits in itertools.combinations(range(64), k)], np.uint64)


def image(x: np.ndarray, bits: int) -> np.ndarray:
    """A fixed linear map to that many bits: the XOR of one random column for each set bit."""
    columns = np.random.default_rng(20240229).integers(1, 1 << 62, 64, dtype=np.int64) & ((1 << bits) - 1)
    out = np.zeros(len(x), np.int64)
    for byte in range(8):
        table = np.zeros(256, np.int64)
        for k in range(8):
            table[1 << k : 2 << k] = table[: 1 << k] ^ columns[8 * byte + k]
        out ^= table[((x >> _U(8 * byte)) & _U(255)).astype(np.int64)]
    return out


def _deal(bits: int, half: int):
    """Map side: each fingerprint to the classes of its variants, packed by class."""

    def run(batches):
        all_masks = np.unique(image(masks(half), bits))
        # where every class gets the whole block, all copies together stay below about 64 MB
        for block in _blocks(batches, "print", max(1 << 8, (1 << 23) >> bits)):
            prints = block.view(np.uint64)
            own = image(prints, bits)
            classes = all_masks[None, :] ^ own[:, None] if len(all_masks) < 1 << bits else None
            if classes is None:  # every class has a variant of every fingerprint
                data = prints.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits)), pa.array([data] * (1 << bits), pa.binary())], names=["class", "data"])
                continue
            for at in range(0, len(prints), 1 << 12):
                part = classes[at : at + (1 << 12)]
                order = np.argsort(part, axis=None, kind="stable")
                sent, who = part.ravel()[order], prints[at : at + (1 << 12)][order // part.shape[1]]
                cut = np.flatnonzero(np.diff(sent, prepend=-1))
                data = [x.tobytes() for x in np.split(who, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(sent[cut]), pa.array(data, pa.binary())], names=["class", "data"])

    return run


def _blocks(batches, name: str, most: int):
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(name).to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _meet(bits: int, half: int, radius: int):
    """Class task: derive the variants of the class, find those that two fingerprints share, link and verify."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cls = key[0].as_py()
        prints = np.unique(np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint64))
        all_masks = masks(half)
        mask_image = image(all_masks, bits)
        order = np.argsort(mask_image, kind="stable")
        all_masks, mask_image = all_masks[order], mask_image[order]
        own = image(prints, bits)
        by_own = np.argsort(own, kind="stable")
        values, cuts = np.unique(own[by_own], return_index=True)
        parts = []  # (fingerprints, masks) whose sums are variants of this class
        for value, rows in zip(values, np.split(by_own, cuts[1:])):
            low, high = np.searchsorted(mask_image, [value ^ cls, (value ^ cls) + 1])
            if high > low:
                parts.append((rows, all_masks[low:high]))
        if not parts:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        variants = np.concatenate([(prints[rows][:, None] ^ m[None, :]).ravel() for rows, m in parts])
        variants.sort()
        shared = np.unique(variants[1:][variants[1:] == variants[:-1]])
        del variants
        if not len(shared):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        # whose variants were the shared ones: a bit table rules most out, then a search decides
        width = max(16, int(len(shared)).bit_length() + 5)
        seen = np.zeros(1 << width, bool)
        mix = lambda x: ((x * _U(0x9E3779B97F4A7C15)) >> _U(64 - width)).astype(np.int64)
        seen[mix(shared)] = True
        hit_v, hit_p = [], []
        for rows, m in parts:
            v = prints[rows][:, None] ^ m[None, :]
            i, j = np.nonzero(seen[mix(v.ravel())].reshape(v.shape))
            v = v[i, j]
            at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
            good = shared[at] == v
            hit_v.append(at[good])
            hit_p.append(rows[i[good]])
        v, p = np.concatenate(hit_v), np.concatenate(hit_p)
        order = np.lexsort((p, v))
        v, p = v[order], p[order]
        first = np.flatnonzero(np.diff(v, prepend=-1))
        head = np.repeat(p[first], np.diff(first, append=len(p)))
        a, b = prints[p], prints[head]
        true = (a != b) & (np.bitwise_count(a ^ b) <= radius)
        node, root = forest(a[true].view(np.int64), b[true].view(np.int64))
        return pa.table({"a": pa.array(node), "b": pa.array(root)})

    return run


def links(prints: DataFrame, radius: int = RADIUS, class_variants: int = CLASS_VARIANTS) -> DataFrame:
    """Links between distinct fingerprints (column print) within the radius; their components are those of all links."""
    spark = prints.sparkSession
    half = (radius + 1) // 2
    n = prints.count()
    balls = len(masks(half))
    needed = max(2 * parallelism(spark), n * balls // class_variants + 1)
    bits = min(30, max(3, int(needed - 1).bit_length()))
    dealt = prints.select("print").mapInArrow(_deal(bits, half), "class long, data binary")
    return dealt.groupBy("class").applyInArrow(_meet(bits, half, radius), LINKS)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, tie (a hash of the text), print (signed 64-bit fingerprint), root (a number of the component), component_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    prints = staged(rows.mapInArrow(_prints, "doc_id long, tie long, print long"), "prints")
    nodes = staged(prints.groupBy("print").agg(F.min("doc_id").alias("low")), "prints-distinct")
    path = scratch(spark, "print-links")
    links(nodes, radius).write.parquet(path)
    rooted = components(spark.read.schema(LINKS).parquet(path))
    # the least id of each component, folded over its fingerprints
    labelled = staged(join_checked(nodes, staged(rooted.withColumnRenamed("node", "print"), "print-roots"), ["print"], "left").withColumn("root", F.coalesce("root", "print")), "print-labelled")
    least = staged(labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "print-components")
    labels = staged(joined(labelled, least, "root").select("print", "root", "component_id"), "print-labels")
    drop_path(spark, path)
    return join_checked(prints, labels, ["print"], "inner").select("doc_id", "tie", "print", "root", "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents."""
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, the one with the least id (null last) and, of those, the least hash of its text.

    Rows that agree in id and text are told apart by nothing that counts; one of them stays.
    """
    like = [free_name(docs, x) for x in ("_id", "_tie")]
    found = near_duplicates(docs).select("doc_id", "tie", "root")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    best = staged(found.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1"), "near-best")
    several = joined(found, best, "root").withColumn("stays", order == F.col("best"))
    sets = staged(several.groupBy(ident(F.col("doc_id")).alias(like[0]), F.col("tie").alias(like[1])).agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "near-found")
    rows = docs.withColumns({like[0]: ident(F.col("doc_id")), like[1]: F.xxhash64("text")})
    rows = join_checked(rows, sets.where("not stays").select(*like), like, "left_anti")
    repeated = sets.where("stays and n > 1").select(*like)
    if not repeated.isEmpty():
        some = join_checked(rows, repeated, like, "left_semi").dropDuplicates(like)
        rows = join_checked(rows, repeated, like, "left_anti").unionByName(some)
    return rows.select(*docs.columns)
