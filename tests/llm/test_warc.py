import base64
import hashlib
import os
import random

from tidelog.llm import common, warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_roundtrip(spark):
    rows = [(1, "u", "<p>a</p>", 1), (2, "u2", "<p>a</p>", 1), (3, None, None, 1), (4, "x\r\ny", "", 1), (0, "v", "é🙂" * 4000, 1), (5, "w", "WARC/1.1\r\n\r\n", 1), (None, "n", "<p>a</p>", 1), (1, "u", "<p>a</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    folder = common.scratch(spark, "t")
    assert sum(r.records for r in warc.write_warc(pages, folder, file_bytes=500).collect()) == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in warc.read_warc(spark, folder).collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        b = (html or "").encode()
        first = min(x[0] for x in rows if x[0] is not None and (x[2] or "").encode() == b)
        want.append((i, len(b), sha(b), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(pages, common.scratch(spark, "t")).count() == 0


def test_salvage_recovers_all_undamaged_records():
    records = [warc.record(i, "u", os.urandom(200) + b"y" * i, None, False) for i in range(30)]
    data, starts = b"".join(records), [0]
    for r in records:
        starts.append(starts[-1] + len(r))
    for seed in range(60):
        r, bad, hit = random.Random(seed), bytearray(data), set()
        for _ in range(3):
            at = r.randrange(len(bad))
            bad[at] ^= r.randrange(1, 256)
            hit.add(max(i for i in range(30) if starts[i] <= at))
        out = list(warc.salvage(bytes(bad)))
        found = {warc._page(x[3]["fields"]["warc-record-id"]) for x in out if x[0] == "record"}
        assert found >= set(range(30)) - hit
        assert [x[1] for x in out] == [0, *[x[2] for x in out[:-1]]] and out[-1][2] == len(data)  # gaps and records tile the file


def test_salvage_plain_records_and_truncation():
    import zlib

    plain = [zlib.decompress(warc.record(i, "u", b"body" * 9, None, False), 31) for i in range(4)]
    data = plain[0] + b"garbage" + plain[1] + plain[2][:-20] + plain[3]
    out = list(warc.salvage(data))
    assert [warc._page(x[3]["fields"]["warc-record-id"]) for x in out if x[0] == "record"] == [0, 1, 3]
    assert [x[0] for x in out] == ["record", "gap", "record", "gap", "record"]
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"xx"))[0][0] == "gap"
    packed = warc.record(1, "u", b"z" * 99, None, False)
    assert list(warc.salvage(packed[:-3]))[0][3].startswith("gzip")


def test_salvage_member_of_several_records():
    import gzip
    import zlib

    plain = [zlib.decompress(warc.record(i, "u", b"body" * 9, None, False), 31) for i in range(4)]
    ids = lambda out: [warc._page(x[3]["fields"]["warc-record-id"]) if x[0] == "record" else "gap" for x in out]
    whole, bad = gzip.compress(b"".join(plain)), gzip.compress(plain[0].replace(b"body", b"bodx", 1) + plain[1] + b"junk" + plain[2])
    assert ids(warc.salvage(whole)) == [0, 1, 2, 3]
    out = list(warc.salvage(whole + bad + warc.record(3, "u", b"z", None, False)))
    assert ids(out) == [0, 1, 2, 3, "gap", 1, "gap", 2, 3]
    assert {x[1:3] for x in out[4:8]} == {(len(whole), len(whole) + len(bad))}


def ids(out):
    return [warc._page(x[3]["fields"]["warc-record-id"]) if x[0] == "record" else "gap" for x in out]


def plain(i, body=b"body" * 9):
    import zlib

    return zlib.decompress(warc.record(i, "u", body, None, False), 31)


def test_a_member_of_any_length_is_salvaged_by_pieces(monkeypatch):
    """Longer than what is held, whole, damaged within its content, and broken off: all records that check come back."""
    import gzip

    body = [os.urandom(3000) for _ in range(40)]
    content = b"".join(plain(i, b) for i, b in enumerate(body))
    bad = bytearray(content)
    bad[content.index(body[7]) + 5] ^= 1
    monkeypatch.setattr(warc, "HELD_BYTES", 10_000)
    monkeypatch.setattr(warc, "PIECE", 4096)
    tail = warc.record(99, "u", b"z", None, False)
    packed = gzip.compress(content)
    assert ids(warc.salvage(packed + tail)) == [*range(40), 99]
    assert ids(warc.salvage(gzip.compress(bytes(bad)) + tail)) == [*range(7), "gap", *range(8, 40), 99]
    cut = packed[: len(packed) // 2]
    out = list(warc.salvage(cut + tail))
    assert ids(out)[-2:] == ["gap", 99] and ids(out)[:-2] == list(range(len(out) - 2)) and len(out) > 15
    assert out[-2][1:3] == (0, len(cut)) and out[-2][3].startswith("gzip")


def test_pieces_give_what_the_whole_gives(monkeypatch):
    """Damaged archives read a few bytes at a time."""
    data = b"".join(warc.record(i, "u", os.urandom(150), None, False) for i in range(12)) + b"junk" + plain(50) + plain(51)[:-9] + plain(52)
    for seed in range(25):
        r, bad = random.Random(seed), bytearray(data)
        for _ in range(3):
            bad[r.randrange(len(bad))] ^= r.randrange(1, 256)
        monkeypatch.setattr(warc, "PIECE", 1 << 20)
        want = list(warc.salvage(bytes(bad)))
        monkeypatch.setattr(warc, "PIECE", 40)
        assert list(warc.salvage(bytes(bad))) == want


def test_time_grows_with_the_records():
    import time

    def took(n):
        data = b"".join(warc.record(i, "u", b"%d" % i * 30, None, False) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.salvage(data)) == n
        return time.process_time() - began

    took(500)
    assert took(16_000) < 8 * 1.5 * took(2_000) + 0.2


def test_only_committed_files_are_read_and_gaps_are_logged(spark):
    folder = common.scratch(spark, "t")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(pages, folder)
    path = files.first().path
    stray = path.replace("file://", "").replace("part-", "part-9")
    open(stray, "wb").write(open(path.replace("file://", ""), "rb").read())
    assert sorted(r.page_id for r in warc.read_warc(spark, files).collect()) == list(range(20))
    assert warc.read_warc(spark, folder).count() == 40
    os.remove(stray)
    with open(path.replace("file://", ""), "r+b") as f:
        f.seek(os.path.getsize(f.name) // 2)
        f.write(b"damaged!")
    got = warc.read_warc(spark, folder).collect()
    gaps = [r for r in got if r.kind == "gap"]
    assert len(gaps) == 1 and gaps[0].stored > 0 and gaps[0].gap_reason and 18 <= sum(r.kind == "response" for r in got) < 20


def test_op1_is_the_operator_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    least = {}
    for r in pages:
        b = (r.html or "").encode()
        least[b] = min(r.page_id, least.get(b, r.page_id))
    want = []
    for r in pages:
        b = (r.html or "").encode()
        first = least[b] == r.page_id
        want.append((r.page_id, len(b), sha(b), "response" if first else "revisit", None if first else least[b]))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op1(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
