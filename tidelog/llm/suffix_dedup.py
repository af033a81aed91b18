"""Repeated 200-byte strings, removed, by families of suffix arrays that merge geometrically.

What is asked of a byte position is whether the LENGTH-byte string that starts there starts anywhere
else. Suffix arrays of all positions would hold every string; most are unique, and a sampled form loses
none of the others:

1. Texts are gathered in map tasks to chunks, compressed, in files of the shared folder; a chunk is the unit that later steps send
   messages to, so nothing is kept on the driver and no step needs all of a group. What is shuffled of a chunk is its place in
   those files; a task that needs its bytes reads them there. Files have the attempt's number in their name, and only those of attempts that succeeded are named by a row.
2. A string's anchor is the leftmost of its ANCHOR-byte substrings with the least hash. Equal strings have equal
   anchors, so a string whose anchor occurs once in the corpus is unique. Chunks send their distinct
   anchor hashes to hash shards. A shard sorts those of the batch, merge-scans them against the levels of earlier batches, which are
   stored files, answers the chunks with those that occur again, and merges levels of equal size.
3. For anchors that occur again, chunks give the context that the strings around them span, once for each
   distinct context and chunk. Anchors found very often (a common line) are passed over where the string has
   another, so that their contexts spread over the shards of rarer anchors. The table of those has a fixed bound. Equal
   contexts are folded to a count before they are dealt, by the tasks that found them first, so a hot passage is one row a task.
4. A shard receives distinct contexts. Batches of them get suffix arrays: the places of their strings in the bytes, in the strings' order. Each
   is merge-scanned against the shard's levels, marking strings that two places have; levels of equal size merge, block by block,
   without copying the strings. The levels are of 1, 2, 4, ... batches, so a place is merged O(log n) times.
5. Contexts get their marks back by a join, and chunks drop the bytes that marked strings cover.

A stored ``Family`` takes further batches: what they repeat of earlier ones, and the reverse, is found without reading chunks that share no anchor.

Defined cases: null is empty; texts shorter than LENGTH lose nothing; equal texts of LENGTH bytes or more lose
everything; matches never cross documents; repeated rows match each other; ids may be null or tie; an
empty table gives an empty result; extra columns are ignored; lone surrogates are encoded as they are.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, join_checked, opened, parallelism, scratch, spread, staged

LENGTH = 200
ANCHOR = 64
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4_000_000
#: Bytes of texts that a task reads, about.
TASK_BYTES = 16_000_000
#: Bytes of the corpus for each shard of anchors and of contexts.
SHARD_BYTES = 2_000_000
#: An anchor in more places than this is very common, or in more than one of MOST_COMMON of all anchors, if that is more.
COMMON = 2_000
MOST_COMMON = 1 << 20
#: Bytes of text for each anchor, about.
ANCHOR_BYTES = (LENGTH - ANCHOR + 1) // 2
#: Strings in one batch of a shard's suffix arrays, and in a block of a merge.
BATCH_STRINGS = 1 << 15

MESSAGE = "chunk long, kind int, number long, data binary"
ASKED = "shard long, chunk long, kind int, data binary"
CONTEXT = "chunk long, h long, digest binary, text binary, places binary"
REPLY = "h long, digest binary, size long, bits binary"
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


# ---- chunks ----


def _chunks(folder: str, batch_number: int):
    """Map side: texts to chunks, written to a file, and a row for each. kind 0: the chunk's place (file, offset, length); number: its texts' bytes."""

    def run(batches):
        task = TaskContext.get()
        first, rows, texts, ids, held = (batch_number << 48) + (task.partitionId() << 24), [], [], [], 0
        store, base = opened(folder)
        name, out = f"part-{task.partitionId()}-{task.taskAttemptId()}", None

        def put():
            nonlocal out, texts, ids, held
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            null = np.array([i is None for i in ids], "u1").tobytes()
            keys = np.array([i or 0 for i in ids], "<i8").tobytes()
            data = len(ids).to_bytes(8, "little") + keys + null + lengths + zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            at = out.tell()
            out.write(data)
            rows.append((first + len(rows), 0, held, json.dumps([f"{folder}/{name}", at, len(data)]).encode()))
            texts, ids, held = [], [], 0

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                if texts and held + len(data) > CHUNK_BYTES:
                    put()
                texts.append(data)
                ids.append(doc)
                held += len(data)
        if texts:
            put()
        if out is not None:
            out.close()
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["chunk", "kind", "number", "data"])

    return run


class Chunk:
    """ids, lengths, ends and the bytes of a chunk, with the strings it holds and their anchors."""

    def __init__(self, place: bytes):
        path, at, size = json.loads(place)
        store, name = opened(path)
        with store.open_input_file(name) as file:
            data = file.read_at(size, at)
        n = int.from_bytes(data[:8], "little")
        self.ids = np.frombuffer(data, "<i8", n, 8)
        self.null = np.frombuffer(data, "u1", n, 8 + 8 * n)
        self.lengths = np.frombuffer(data, "<i8", n, 8 + 9 * n)
        self.ends = np.cumsum(self.lengths)
        self.body = zstandard.ZstdDecompressor().decompress(data[8 + 17 * n :], max_output_size=max(1, int(self.lengths.sum())))
        self.bytes = np.frombuffer(self.body, np.uint8)

    def starts(self) -> np.ndarray:
        """Places where a string of LENGTH bytes lies within one text, as flags."""
        flags = np.zeros(len(self.bytes), bool)
        for end, n in zip(self.ends.tolist(), self.lengths.tolist()):
            if n >= LENGTH:
                flags[end - n : end - LENGTH + 1] = True
        return flags


def rolling(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each ANCHOR-byte substring, by doubling."""
    table = np.random.default_rng(977).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
    h, n, factor = table[data], 1, 0x9E3779B97F4A7C15
    while n < ANCHOR:
        h = h[: len(h) - n] * _U(factor) + h[n:]
        factor, n = factor * factor % (1 << 64), 2 * n
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return np.minimum(h, _TOP - _U(1))


def _leftmost_least(h: np.ndarray) -> np.ndarray:
    """For each string start, the place of its anchor."""
    width = LENGTH - ANCHOR + 1
    n = len(h) - width + 1
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * span <= width:
        right = low[span:] < low[:-span]  # the left one stays at a tie
        at = np.where(right, at[span:], at[:-span])
        low = np.where(right, low[span:], low[:-span])
        span *= 2
    shift = width - span
    if shift:
        a, b = low[:n], low[shift : shift + n]
        return np.where(b < a, at[shift : shift + n], at[:n])
    return at[:n]


#: Strings handled at once, so that the arrays stay in the processor's cache.
BLOCK = 1 << 17


class Common:
    """A sorted table of very common hashes, with a bit table that rules most others out."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.table = hashes
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[(hashes >> _U(64 - self.BITS)).astype(np.int64)] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = self.bits[(h >> _U(64 - self.BITS)).astype(np.int64)]
        some = np.flatnonzero(found)
        found[some] = _among(h[some], self.table)
        return found


def anchors(chunk: Chunk, common: Common | None = None):
    """The chunk's runs of strings with one anchor: (first start, last start, anchor hash, anchor place, moved).

    moved: the plain anchor is very common and the strings took the least of their other anchors. That depends on
    nothing but the string and the table, which is the same for all chunks, so equal strings still agree.
    """
    flags = chunk.starts()
    out = []
    for low in range(0, max(0, len(chunk.bytes) - LENGTH + 1), BLOCK):
        part = chunk.bytes[low : low + BLOCK + LENGTH - 1]
        here = flags[low : low + BLOCK][: len(part) - LENGTH + 1]
        if not here.any():
            continue
        h = rolling(part)
        at = _leftmost_least(h)[: len(here)]
        good = np.flatnonzero(here)
        at = at[good]
        moved = np.zeros(len(good), bool)
        if common is not None:
            is_common = common.holds(h)
            moved = is_common[at]
            if moved.any():
                order = np.where(is_common, _TOP, h)
                other = _leftmost_least(order)[: len(here)][good]
                moved &= order[other] != _TOP  # strings with common anchors only keep theirs
                at = np.where(moved, other, at)
        change = (np.diff(at, prepend=-1) != 0) | (np.diff(good, prepend=-2) != 1) | (np.diff(moved, prepend=False))
        change[0] = True
        cut = np.flatnonzero(change)
        last = np.append(cut[1:], len(good)) - 1
        out.append((good[cut] + low, good[last] + low, h[at[cut]], at[cut].astype(np.int64) + low, moved[cut]))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, _U, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


# ---- anchors that occur again ----


def _send_anchors(shards: int):
    """Chunk side: to each shard the chunk's distinct anchor hashes, with how often each occurs."""

    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                c = Chunk(data.as_py())
                _, _, hashes, place, _ = anchors(c)
                keep = np.unique(place, return_index=True)[1]  # an anchor may begin two runs
                values, counts = np.unique(hashes[keep], return_counts=True)
                shard = (values % _U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                values, counts, shard = values[order], np.minimum(counts[order], 1 << 30).astype("<u4"), shard[order]
                cut = np.flatnonzero(np.diff(shard, prepend=-1))
                stop = np.append(cut[1:], len(shard))
                packed = [values[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(cut.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cut]), pa.array(np.full(len(cut), chunk)), pa.array(np.zeros(len(cut), np.int32)), pa.array(packed, pa.binary())], names=["shard", "chunk", "kind", "data"]
                )

    return run


ENTRY = np.dtype([("hash", "<u8"), ("chunk", "<i8"), ("count", "<u4")])


def _entries(chunk: int, data: bytes) -> np.ndarray:
    n = len(data) // 12
    out = np.empty(n, ENTRY)
    out["hash"], out["chunk"], out["count"] = np.frombuffer(data, "<u8", n), chunk, np.frombuffer(data, "<u4", n, 8 * n)
    return out


def _by_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Levels merged: entries in the order of their hashes."""
    together = np.concatenate([np.empty(0, ENTRY), *parts])
    return together[np.argsort(together["hash"], kind="stable")]


def _answer_anchors(most: int, merged: int | None):
    """Shard side: to each chunk those of the batch's hashes that occur in two places, of the batch or of stored levels.

    The very common ones go out once, for all (kind 2). merged: levels below this number become one with the batch's entries (kind 4,
    chunk: the shard); None: nothing is stored.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kinds, chunks, packed = (table.column(c).to_pylist() for c in ("kind", "chunk", "data"))
        new = _by_hash([_entries(c, x) for k, c, x in zip(kinds, chunks, packed) if k == 0])
        levels = {c: np.frombuffer(x, ENTRY) for k, c, x in zip(kinds, chunks, packed) if k == 1}
        values, first = np.unique(new["hash"], return_index=True)
        total = np.add.reduceat(new["count"].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        found = [new]
        for level in levels.values():  # both sides are sorted: a scan along the level
            at = np.searchsorted(values, level["hash"])
            here = at < len(values)
            here[here] = values[at[here]] == level["hash"][here]
            total += np.bincount(at[here], level["count"][here], len(values)).astype(np.int64)
            found.append(level[here])
        again = values[total > 1]
        told = np.concatenate(found)
        told = told[_among(told["hash"], again)]
        told = told[np.argsort(told["chunk"], kind="stable")]
        cut = np.flatnonzero(np.diff(told["chunk"], prepend=-1))
        out = [(-1, 2, values[total > most].tobytes())]
        out += [(int(part["chunk"][0]), 1, part["hash"].tobytes()) for part in np.split(told, cut[1:]) if len(part)]
        if merged is not None:
            out.append((key[0].as_py(), 4, _by_hash([*(x for number, x in levels.items() if number < merged), new]).tobytes()))
        return _messages(out)

    return run


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({
        "chunk": pa.array([x[0] for x in rows], pa.int64()), "kind": pa.array([x[1] for x in rows], pa.int32()),
        "number": pa.array([0] * len(rows), pa.int64()), "data": pa.array([x[2] for x in rows], pa.binary()),
    })


# ---- contexts ----


def _by_kind(table: pa.Table) -> dict[int, list[bytes]]:
    found: dict[int, list[bytes]] = {}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
        found.setdefault(kind, []).append(data)
    return found


def _send_contexts(common: np.ndarray):
    """Chunk side: the distinct contexts of anchors that occur again, and where in the chunk they are.

    A context is the bytes from its first string's start to its last one's end.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = _by_kind(table)
        found: dict[tuple, list[int]] = {}
        if 1 in parts:  # a chunk without an answer has no string whose anchor occurs again, very common or not
            c = Chunk(parts[0][0])
            again = np.unique(np.frombuffer(b"".join(parts[1]), _U))
            first, last, hashes, _, moved = anchors(c, Common(common) if len(common) else None)
            runs = np.flatnonzero(moved | _among(hashes, again))  # moved strings' anchors haven't been asked about
            for a, b, h in zip(first[runs].tolist(), (last[runs] + LENGTH).tolist(), hashes[runs].view(np.int64).tolist()):
                found.setdefault((h, c.body[a:b]), []).append(a)
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(found), pa.int64()), "h": pa.array([h for h, _ in found], pa.int64()),
            "digest": pa.array([hashlib.blake2b(text, digest_size=16).digest() for _, text in found], pa.binary()), "text": pa.array([text for _, text in found], pa.binary()),
            "places": pa.array([np.array(at, "<i8").tobytes() for at in found.values()], pa.binary()),
        })

    return run


class Suffixes:
    """A family of suffix arrays over some bytes: places in the order of the LENGTH bytes that begin there, distinct strings only.

    A level holds 2^k batches. ``marked`` are the places whose string two places have; strings are compared where they lie.
    """

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.strings = np.ndarray((max(0, len(data) - LENGTH + 1),), f"S{LENGTH}", self.data, strides=(1,))
        self.levels: list[np.ndarray | None] = []
        self.marked = np.zeros(len(data), bool)

    def add(self, places: np.ndarray) -> None:
        """Suffix array of a batch, merge-scan against all levels, then geometric merges."""
        strings = self.strings[places]
        order = np.argsort(strings, kind="stable")
        places, strings = places[order], strings[order]
        same = strings[1:] == strings[:-1]
        self.marked[places[np.append(same, False) | np.insert(same, 0, False)]] = True
        places = places[np.insert(~same, 0, True)[: len(places)]]
        for level in self.levels:
            if level is not None and len(places):
                places = self._scan(level, places)  # strings that a level has needn't be held twice
        k = 0
        while k < len(self.levels) and self.levels[k] is not None:
            level, self.levels[k] = self.levels[k], None
            places = np.insert(level, self._below(level, places), places)
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = places if len(places) else None

    def _below(self, level: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each of the sorted places how many of the level are less: one walk along both, in blocks."""
        out = np.full(len(places), len(level), np.int64)
        done = 0
        for low in range(0, len(level), BATCH_STRINGS):
            part = self.strings[level[low : low + BATCH_STRINGS]]
            while done < len(places):
                own = self.strings[places[done : done + BATCH_STRINGS]]
                end = int(np.searchsorted(own, part[-1], side="right"))
                out[done : done + end] = low + np.searchsorted(part, own[:end])
                done += end
                if end < len(own):
                    break
            if done == len(places):
                break
        return out

    def _scan(self, level: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The places whose strings the level doesn't have; the others are marked, on both sides."""
        at = np.minimum(self._below(level, places), len(level) - 1)
        match = np.zeros(len(places), bool)
        for low in range(0, len(places), BATCH_STRINGS):
            part = slice(low, low + BATCH_STRINGS)
            match[part] = self.strings[level[at[part]]] == self.strings[places[part]]
        self.marked[level[at[match]]] = True
        self.marked[places[match]] = True
        return places[~match]


def _match(key: tuple, table: pa.Table) -> pa.Table:
    """Shard side: distinct contexts in, with how often each stands; out those with repeated strings, and which strings those are."""
    texts, h = table.column("text").to_pylist(), table.column("h").to_numpy()
    often = table.column("n").to_numpy() > 1
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    suffixes = Suffixes(b"".join(texts))
    del texts
    _, at, shares = np.unique(h, return_inverse=True, return_counts=True)
    batch, held = [], 0
    for i in np.flatnonzero(shares[at] > 1).tolist():  # else no other context has this anchor, so none has one of its strings
        batch.append(np.arange(base[i], base[i + 1] - LENGTH + 1))
        held += len(batch[-1])
        if held >= BATCH_STRINGS:
            suffixes.add(np.concatenate(batch))
            batch, held = [], 0
    if batch:
        suffixes.add(np.concatenate(batch))
    rows = []
    for i in range(len(sizes)):
        size = int(sizes[i]) - LENGTH + 1
        found = np.ones(size, bool) if often[i] else suffixes.marked[base[i] : base[i] + size]
        if found.any():
            rows.append((i, size, np.packbits(found).tobytes()))
    who = pa.array([r[0] for r in rows], pa.int64())
    return pa.table({
        "h": table.column("h").take(who), "digest": table.column("digest").take(who), "size": pa.array([r[1] for r in rows], pa.int64()), "bits": pa.array([r[2] for r in rows], pa.binary()),
    })


# ---- what stays ----

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(keep_text: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = _by_kind(table)
        c = Chunk(parts[0][0])
        covered = np.zeros(len(c.bytes) + 1, np.int64)
        for number, data in zip(*(table.column(x).to_pylist() for x in ("number", "data")) if 3 in parts else ((), ())):
            if number >= 0:
                continue
            width = (7 - number) // 8  # bytes of the marks of -number strings
            places = np.frombuffer(data, "<i8", (len(data) - width) // 8)
            found = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, width, len(data) - width), count=-number))
            starts = (places[:, None] + found[None, :]).ravel()
            np.add.at(covered, starts, 1)  # a chunk may hear of a string again in a later batch
            np.subtract.at(covered, starts + LENGTH, 1)
        gone = np.cumsum(covered[:-1]) > 0
        rows = []
        for doc, null, end, n in zip(c.ids.tolist(), c.null.tolist(), c.ends.tolist(), c.lengths.tolist()):
            own = gone[end - n : end]
            removed = int(own.sum())
            spans = int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1)) if removed else 0
            left = c.bytes[end - n : end][~own].tobytes() if removed else c.body[end - n : end]
            rows.append((None if null else doc, n, removed, spans, hashlib.sha256(left).hexdigest(), left))
        names = [x.split()[0] for x in RESULT.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()]
        table = {k: pa.array([x[i] for x in rows], types[i]) for i, k in enumerate(names)}
        return pa.table(table | ({"kept_bytes": pa.array([x[5] for x in rows], pa.binary())} if keep_text else {}))

    return run


class Family:
    """Documents that came in batches, in a shared folder: chunks, levels of sorted anchors (1, 2, 4, ... batches each), and marks.

    ``state.json`` names the files; it is written last, so a batch that failed leaves the family as it was. shards: set at creation, for the size that the
    family is to reach (by default that of its first batch).
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int | None = None, stored: bool = True):
        self.spark, self.folder, self.stored = spark, folder, stored
        self.state = self._load() or {"shards": shards, "bytes": 0, "batches": 0, "chunks": [], "marks": [], "levels": [], "texts": []}

    def _path(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state.json")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _load(self) -> dict | None:
        store, path = self._path()
        return json.loads(self.spark.read.option("wholetext", True).text(str(path)).first()[0]) if store.exists(path) else None

    def _save(self) -> None:
        store, path = self._path()
        out = store.create(path, True)
        out.write(json.dumps(self.state).encode())
        out.close()

    def _kept(self, df: DataFrame, name: str) -> str:
        path = scratch(self.spark, f"suffix-{name}") if not self.stored else f"{self.folder}/{name}-{self.state['batches']}"
        df.write.mode("overwrite").option("compression", "zstd" if name == "contexts" else "none").parquet(path)
        return path

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _tasks(self, n_bytes: int) -> int:
        """Tasks for chunks of so many bytes: the rows that are dealt are only their places, so their own size says nothing."""
        return max(parallelism(self.spark), int(n_bytes // TASK_BYTES) + 1)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Take a batch: its strings are looked for in itself and in all earlier batches, and theirs in it."""
        state = self.state
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        texts = scratch(self.spark, "suffix-texts") if not self.stored else f"{self.folder}/texts-{state['batches']}"
        path = self._kept(rows.mapInArrow(_chunks(texts, state["batches"]), MESSAGE), "chunks")
        chunks = self._read([path], MESSAGE)
        size = chunks.agg(F.sum("number")).first()[0] or 0
        total, shards = state["bytes"] + size, state["shards"] or max(16, int(size // SHARD_BYTES) + 1)
        # equal sizes merge: a counter in base two
        levels, merged, new = list(state["levels"]), 0, 1
        while merged < len(levels) and levels[merged]["batches"] == new:
            new += levels[merged]["batches"]
            merged += 1
        asked = chunks.select("chunk", "data").repartition(self._tasks(size)).mapInArrow(_send_anchors(shards), ASKED)
        for number, level in enumerate(levels):
            entries = self._read([level["path"]], MESSAGE).where("kind = 4")
            asked = asked.unionByName(entries.select(F.col("chunk").alias("shard"), F.lit(number).cast("long").alias("chunk"), F.lit(1).alias("kind"), "data"))
        most = max(COMMON, int(total // ANCHOR_BYTES) // MOST_COMMON)
        answers = self._kept(asked.groupBy("shard").applyInArrow(_answer_anchors(most, merged if self.stored else None), MESSAGE), "anchors")
        known = self._read([answers], MESSAGE)
        # at most MOST_COMMON hashes have that many of the anchors, so this is bounded for every corpus
        common = np.unique(np.frombuffer(b"".join(r["data"] for r in known.where("kind = 2").select("data").collect()), _U))
        told = known.where("kind = 1")
        if state["chunks"]:
            old = self._read(state["chunks"], MESSAGE)
            heard = staged(told.select("chunk").distinct(), "suffix-heard")
            chunks = chunks.unionByName(join_checked(old, heard, ["chunk"], "left_semi"))
        contexts = self._kept(chunks.unionByName(told).repartition(self._tasks(total), "chunk").groupBy("chunk").applyInArrow(_send_contexts(common), CONTEXT), "contexts")
        found = self._read([contexts], CONTEXT)
        distinct = found.groupBy("h", "digest", "text").agg(F.sum(F.octet_length("places") / 8).cast("long").alias("n"))
        replies = staged(distinct.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(_match, REPLY), "suffix-replies")
        marks = join_checked(found.select("chunk", "h", "digest", "places"), replies, ["h", "digest"], "inner")
        marks = marks.select("chunk", F.lit(3).alias("kind"), (-F.col("size")).alias("number"), F.concat("places", "bits").alias("data"))
        self.state = {
            "shards": shards, "bytes": total, "batches": state["batches"] + 1, "chunks": [*state["chunks"], path], "marks": [*state["marks"], self._kept(marks, "marks")],
            "levels": [{"batches": new, "path": answers}, *levels[merged:]], "texts": [*state["texts"], texts],
        }
        drop_path(self.spark, contexts)
        if self.stored:
            self._save()

    def result(self, keep_text: bool = False) -> DataFrame:
        """One row per row of all batches: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (, kept_bytes)."""
        parts = self._read(self.state["chunks"], MESSAGE).unionByName(self._read(self.state["marks"], MESSAGE))
        return parts.repartition(self._tasks(self.state["bytes"]), "chunk").groupBy("chunk").applyInArrow(_finish(keep_text), RESULT + (", kept_bytes binary" if keep_text else ""))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (, kept_bytes)."""
    family = Family(docs.sparkSession, scratch(docs.sparkSession, "suffix"), stored=False)
    family.add(docs, doc_id, text)
    out = staged(family.result(keep_text), "suffix-result")
    for path in (*family.state["texts"], *family.state["chunks"], *family.state["marks"], *(x["path"] for x in family.state["levels"])):
        drop_path(docs.sparkSession, path)
    return out


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents."""
    return remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
