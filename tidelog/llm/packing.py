"""Best-fit packing of token sequences under several capacities.

Documents are tokenized whole and cut only where they are longer than a sequence; the first piece is then the
shorter one. Pieces are placed by vector best-fit: in order of falling length a piece goes to the open
bin that fits it under every capacity (residual tokens, documents, attention cost) with the best score,
the weighted dot product of the piece with the bin's residuals, or the least norm of what stays.

The placement runs on the histogram of piece lengths, so its state doesn't grow with the corpus: bins of
one content are one class with a count, and whole runs of equal pieces are placed at once. Pieces then
find their bin by their rank among pieces of the same length. Ranks come from counts per map task (in
the order of the input) and a running sum over those counts; no group of pieces meets in one task.

Defined cases: null text is empty; an empty document is one piece, the end mark; repeated rows are packed
each; ids may be null or tie; very long texts give many full pieces, each a sequence of its own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import collections
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_checked, spread, staged

END_ID = 2

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, task long, rank long"


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    #: a document has a token at least, so the tokens bind first unless this is set lower
    documents: int = 1024
    #: sum of squared piece lengths, as attention within documents costs
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "residual_norm"  # or "dot_product"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How vocabularies of byte-level pairs cut a text into words (fixed value).
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Ids:
    """Ids of a text as little-endian 32-bit bytes, as the library gives them without added tokens; the string of a special token is that token.

    Plain byte-level pair vocabularies are encoded by another implementation of the same merges, several times as fast; where the
    vocabulary file says more than that (a normaliser, another cut into words), the library encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.fast = self._fast(path)

    def _fast(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        words, model = said.get("pre_tokenizer") or {}, said["model"]
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not said.get("normalizer")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        if not plain or said.get("truncation") or any(model.get(k) for k in odd):
            return None
        added = {t.content: (i, t) for i, t in self.encoder.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip for _, t in added.values()):
            return None
        byte = _byte_letters()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={token: i for token, (i, _) in added.items()})

    def __call__(self, text: str) -> bytes:
        if self.fast:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first can be shorter."""
    head = n % most
    return ([(0, head)] if head or not n else []) + [(s, most) for s in range(head, n, most)]


def _tokenize(path: str, most: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = Ids(path)
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        row = 0
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = memoryview(ids_of(text or "") + end)
                for k, (start, length) in enumerate(cut(len(data) // 4, most)):
                    part = data[4 * start : 4 * (start + length)]
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    out.append((doc, row, k, start, length, zlib.crc32(part), task, rank, *([bytes(part)] if keep_ids else [])))
                row += 1
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * keep_ids
            types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in zip(range(len(names)), types)], names=names)

    return run


def pack_lengths(counts: dict[int, int], cap: Capacity = Capacity()) -> list[tuple[tuple[int, ...], int]]:
    """Vector best-fit of a histogram of lengths: [(lengths in a bin, number of such bins)]."""
    limit = np.array([cap.tokens, cap.documents, cap.cost], float)
    weights = np.array(cap.weights, float)
    contents: list[tuple[int, ...]] = []
    left = np.empty((0, 3))
    number = np.empty(0, np.int64)
    at: dict[tuple[int, ...], int] = {}

    def add(content: tuple[int, ...], rest: np.ndarray, n: int) -> None:
        nonlocal left, number
        if content in at:
            number[at[content]] += n
        else:
            at[content] = len(contents)
            contents.append(content)
            left, number = np.vstack([left, rest]), np.append(number, n)

    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], float)
        if length > cap.tokens or (item > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        todo = counts[length]
        while todo:
            fits = np.flatnonzero((number > 0) & (left >= item).all(axis=1))
            if not len(fits):
                alone = int(min(limit // item))  # new bins take as many equal pieces as they hold
                full, over = divmod(todo, alone)
                for content, n in (((length,) * alone, full), ((length,) * over, 1 if over else 0)):
                    if n:
                        add(content, limit - item * len(content), n)
                break
            rest = left[fits] / limit
            size = item / limit
            if cap.score == "dot_product":
                best = fits[np.argmin((rest * size * weights).sum(axis=1))]
            else:
                best = fits[np.argmin(((rest - size) ** 2 * weights).sum(axis=1))]
            n = int(min(todo, number[best]))
            number[best] -= n
            add((*contents[best], length), left[best] - item, n)
            todo -= n
    return [(c, int(n)) for c, n in zip(contents, number) if n]


def slots(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset), by length without gaps."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for content, n in bins:
        offset = 0
        for length in content:
            low = used.get(length, 0)
            out.append((length, low, low + n, sequence, offset))
            used[length] = low + n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, cap: Capacity = Capacity(), end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, row (tells repeated ids apart, with task), piece, start, length, ids_crc32, sequence_id, offset (, ids)."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = staged(rows.mapInArrow(_tokenize(path, cap.tokens, end_id, keep_ids), PIECES + (", ids binary" if keep_ids else "")), "pieces")
    counts = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row for each length
    order = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = staged(counts.select("length", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")), "piece-starts")
    table = slots(pack_lengths(total, cap))
    # a length's slots are runs of ranks; the table has a row for each class of bins and piece in it, however many bins there are
    schema = "length long, low long, high long, first long, offset long"
    places = spark.createDataFrame(table, schema) if table else spark.createDataFrame([], schema)
    by_length = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("runs"))
    most = max(collections.Counter(r[0] for r in table).values(), default=1)
    ranked = join_checked(pieces, starts, ["length", "task"], "inner").withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    found = ranked.join(F.broadcast(by_length), "length")  # at most a row for each length
    # the last run that begins at the rank or before, by bisection
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    at = F.aggregate(halves, F.lit(0), lambda low, half: F.when(F.coalesce(F.get("runs", low + half)["low"] <= F.col("rank"), F.lit(False)), low + half).otherwise(low))
    out = found.withColumn("place", F.get("runs", at))
    return out.select(
        "doc_id", "task", "row", "piece", "start", "length", "ids_crc32",
        (F.col("place.first") + F.col("rank") - F.col("place.low")).alias("sequence_id"), F.col("place.offset").alias("offset"), *(["ids"] if keep_ids else []),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents."""
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).drop("task", "row")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces of docs."""
    return pack(docs).drop("task", "row")
