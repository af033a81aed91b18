"""WARC archives: a writer that replaces repeated payloads by revisit records, and a salvage reader.

Writer: one file a task attempt and size limit, each record a gzip member of its own. A file appears under its name
only when it is whole (written beside and moved), and the table of written files names those of the attempts
that succeeded; what other attempts leave behind is never read.

Salvage reader: a record that fails a check (gzip stream, version line, header, length, digest) ends
trust in the offsets that follow. The reader then searches for the next gzip member that opens with a
version line, or the next version line in plain files, and goes on from there; the bytes between
are reported as a gap with their place and reason. Records after damage are never lost. Files are read in
bounded pieces, so a file, or a gzip member of many records, may be of any size; only a record is held whole.

Defined cases: a null payload is empty; equal payloads, the empty one too, are one response (the smallest
page_id; null sorts last) and revisits; rows that share the smallest id are all responses; repeated
rows give a record each; very long payloads are one record; an empty table gives no file and no row; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, join_checked, opened, scratch, staged

FILE_BYTES = 32_000_000
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
_VERSION_AT = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_ANCHOR = re.compile(_MEMBER + rb"|" + _VERSION_AT.pattern)
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n")
#: Bytes read at once, and the most that a header has.
PIECE = 1 << 20
#: A gzip member's content is held up to so many bytes; a longer one is unpacked again, piece by piece.
HELD_BYTES = 1 << 26
#: A longer record fits no row.
MOST_BYTES = (1 << 31) - (1 << 21)

WRITTEN = "path string, records long, bytes long"
RECORD = (
    "path string, offset long, stored long, kind string, page_id long, url string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary, gap_reason string"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers: bool, name: str | None = None) -> bytes:
    """One record, a gzip member. A revisit has the HTTP head, which states the full length, and no payload."""
    name = "null" if page_id is None else str(page_id)
    uri = re.sub(r"[\r\n]", "%0A", url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers else head + payload
    lines = [
        f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(body)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers:
        lines += [f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    text = VERSION + "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode("utf-8", "surrogatepass")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text + body + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, most: int):
    def run(batches):
        store, base = opened(folder)
        task = TaskContext.get()
        out, n, size, part = None, 0, 0, 0
        rows = []

        def close():
            nonlocal out, n, size, part
            out.close()
            path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part:04d}.warc.gz"
            store.move(hidden, f"{base}/{path}")
            rows.append((f"{folder}/{path}", n, size))
            out, n, size, part = None, 0, 0, part + 1

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers", "refers_to"))
            for page_id, url, html, refers, refers_to in zip(*columns):
                if out is None:
                    store.create_dir(base, recursive=True)
                    hidden = f"{base}/.{task.partitionId()}-{part}-{task.taskAttemptId()}"
                    out = store.open_output_stream(hidden)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, bool(refers))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= most:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record for each row of pages (page_id, url, html) under folder; (path, records, bytes) of the files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit(""))))
    # the first of each payload: a fold by digest, small rows only; payloads themselves aren't dealt by digest unless repeats are very many
    again = staged(
        rows.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to", F.lit(True).alias("again")),
        "warc-repeats",
    )
    rows = join_checked(rows, again, ["sha"], "left")
    rows = rows.withColumn("refers", F.coalesce(F.col("again") & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False)))
    return staged(rows.select("page_id", "url", "html", "refers", "refers_to").mapInArrow(_writer(folder, file_bytes), WRITTEN), "warc-written")


def parse(data: bytes) -> dict | str:
    """A record's fields from its bytes, or why it isn't one."""
    if not _VERSION_AT.match(data):
        return "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "header without end"
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without colon"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogateescape")
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        return "no content length"
    body = data[end + 4 : end + 4 + length]
    if length < 0 or len(body) < length:
        return "content shorter than its length"
    if data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
        return "content not ended"
    block = fields.get("warc-block-digest", "")
    if block.startswith("sha1:") and block[5:] != digest(body):
        return "block digest differs"
    head, _, payload = body.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    if kind == "response" and (want := fields.get("warc-payload-digest", "")).startswith("sha1:") and want[5:] != digest(payload):
        return "payload digest differs"
    digested = block.startswith("sha1:") or (kind == "response" and fields.get("warc-payload-digest", "").startswith("sha1:"))
    return {"fields": fields, "head": head, "payload": payload, "kind": kind, "used": end + 8 + length, "digested": digested}


class Window:
    """Bytes from a place on: of a function read(at, n) over so many bytes, or of pieces that come in order and aren't asked for again."""

    def __init__(self, data: bytes = b"", read=None, size: int | None = None, pieces: Iterator[bytes] | None = None):
        self.read, self.size, self.pieces = read or (lambda at, n: data[at : at + n]), len(data) if size is None else size, pieces
        self.low, self.held = 0, b""

    def part(self, at: int, n: int) -> bytes:
        """n bytes at a place, fewer at the end."""
        if at < self.low or at + n > self.low + len(self.held):
            if self.pieces is None:
                self.low, self.held = at, bytes(self.read(at, min(max(n, PIECE), self.size - at))) if at < self.size else b""
            else:
                got, have = [self.held], self.low + len(self.held)
                while have < at + n and (piece := next(self.pieces, None)) is not None:
                    got.append(piece)
                    have += len(piece)
                self.held = b"".join(got)
        return self.held[at - self.low : at - self.low + n]

    def forget(self, at: int) -> None:
        """Nothing before this place will be asked for."""
        if at - self.low > PIECE and at <= self.low + len(self.held):
            self.low, self.held = at, self.held[at - self.low :]

    def anchor(self, at: int) -> int | None:
        """The next place where a gzip member's or a version line's bytes stand."""
        while part := self.part(at, PIECE):
            if found := _ANCHOR.search(part):
                return at + found.start()
            at += max(1, len(part) - 16)
            self.forget(at)
            if len(part) < PIECE:
                return None
        return None


def _unpacked(w: Window, at: int, told: dict) -> Iterator[bytes]:
    """The content of the gzip member at a place, by pieces; told gets its end, or why there is none."""
    reader, step = zlib.decompressobj(31), 1024  # small records need small steps: what follows them is copied
    while not reader.eof:
        piece = w.part(at, step)
        if not piece:
            told["why"] = "gzip: stream cut off"
            return
        at, step = at + len(piece), min(2 * step, PIECE)
        while piece and not reader.eof:
            try:
                out = reader.decompress(piece, 8 * PIECE)
            except zlib.error as e:
                told["why"] = f"gzip: {str(e)[:60]}"
                return
            piece = reader.unconsumed_tail
            if out:
                yield out
    told["end"] = at - len(reader.unused_data)


def _plain(w: Window, at: int) -> dict | str:
    """The record at a place of plain bytes, or why there is none."""
    if not _VERSION_AT.match(w.part(at, 16)):
        return "no version line"
    for n in (4096, 1 << 16, PIECE):
        head = w.part(at, n)
        end = head.find(b"\r\n\r\n")
        if end >= 0 or len(head) < n:
            break
    if end < 0:
        return "header without end"
    length = _LENGTH.search(head[: end + 2])
    if length and int(length[1]) > MOST_BYTES:
        return "content longer than a row"
    return parse(w.part(at, end + 8 + int(length[1])) if length else head[: end + 4])


def salvage(source: bytes | Window, members: bool = True):
    """Yield ("record", start, end, parsed) and ("gap", start, end, reason), in order and without overlap.

    What a gzip member of several records (or of records and damage) holds is salvaged too; all of it bears the member's own start and
    end. Of a member whose stream breaks, records with a digest that others follow are yielded with the place of the member and no length; the gap comes after them.
    """
    w = source if isinstance(source, Window) else Window(source)
    at, gap, why = 0, None, ""
    while first := w.part(at, 3):
        w.forget(at)
        end, found = None, ""
        if members and first == _MEMBER:
            told, held, size = {}, [], 0
            for piece in _unpacked(w, at, told):
                size += len(piece)
                held = [*held, piece] if size <= HELD_BYTES else []
            end, found = told.get("end"), told.get("why", "no version line")
            inner = Window(b"".join(held)) if size <= HELD_BYTES else Window(pieces=_unpacked(w, at, {}))
            some, lead = False, []  # lead: gaps before the first record
            for what, start, stop, x in salvage(inner, False):
                if end is None and not (what == "record" and stop < size and x["digested"]):
                    continue
                if what == "record" and not some:
                    some = True
                    if gap is not None:
                        yield "gap", gap, at, why
                        gap = None
                    yield from lead
                item = (what, at, at if end is None else end, x)
                if some:
                    yield item
                else:
                    found = x
                    lead.append(item)
            if some and end is not None:
                at = end
                continue
        else:
            found = _plain(w, at)
            if isinstance(found, dict):
                if gap is not None:
                    yield "gap", gap, at, why
                    gap = None
                end = at + found["used"]
                yield "record", at, end, found
                at = end
                continue
        if gap is None:
            gap, why = at, found
        at = _next(w, at + 1, members)
        if at is None:
            break
    if gap is not None:
        yield "gap", gap, w.low + len(w.held) if w.pieces is not None else w.size, why


def _next(w: Window, at: int, members: bool = True) -> int | None:
    """Where the next member that opens with a version line, or the next plain version line, begins."""
    while (at := w.anchor(at)) is not None:
        if w.part(at, 1) == b"W":
            return at
        if members:
            try:
                if zlib.decompressobj(31).decompress(w.part(at, 4096), 64).startswith(b"WARC/1."):
                    return at
            except zlib.error:
                pass
        at += 1
    return None


def _page(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def _read(batches):
    schema = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [x.strip().split()[0] for x in RECORD.split(",")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema)], names=names)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, held = [], 0
            store, name = opened(path)
            with store.open_input_file(name) as file:
                for what, start, end, x in salvage(Window(read=lambda at, n: file.read_at(n, at), size=file.size())):
                    if what == "gap":
                        rows.append((path, start, end - start, "gap", None, None, None, None, None, None, x))
                        continue
                    fields = x["fields"]
                    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", x["head"])
                    rows.append((
                        path, start, end - start, x["kind"], _page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"),
                        int(length[1]) if length and x["kind"] == "revisit" else len(x["payload"]), fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                        _page(fields.get("warc-refers-to", "")), x["payload"], None,
                    ))
                    held += len(x["payload"])
                    if held > 8_000_000 or len(rows) >= 10_000:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)


def read_warc(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """Records and gaps of WARC files, one row each, kind ``gap`` for quarantined bytes. files: a table with their paths (column path), or a folder.

    A file is one task's work, read in pieces by its URI.
    """
    if isinstance(files, str):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(files)
    return files.select("path").mapInArrow(_read, RECORD)


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract query over all pages: write the archives, read them back, delete them."""
    folder = scratch(spark, "warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    n = files.count()
    if not n:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read_warc(spark, files.repartitionByRange(n, "path")).where("kind <> 'gap'")  # a file a task
    result = staged(found.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"), "warc-read")
    drop_path(spark, folder)
    return result


ORACLE_OP1 = None
