import collections
import random
import zlib

import numpy as np
import pytest

from tidelog.llm import packing

from .helpers import awkward, docs


def test_pack(spark):
    rows = awkward()
    got = packing.pack(docs(spark, rows), keep_ids=True).collect()
    ids = packing.Ids(packing.vocabulary_path())
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[(r.doc_id, r.task, r.row)].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter()
    for i, t, *_ in rows:
        want[(i, np.array([*ids.encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    found = collections.Counter()
    for (i, _, _), pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert all(r.length == 1024 for r in pieces[1:]) and all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
        found[(i, b"".join(r.ids for r in pieces))] += 1
    assert found == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_no_rows(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_ids_equal_the_library():
    ids = packing.Ids(packing.vocabulary_path())
    for t in ["a  b", "x \n y ", "", "  ", "é<|endoftext|> z   k", "a\n b", "don't 12,3\t\t"]:
        assert ids(t) == np.array(ids.encoder.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("score", ["residual_norm", "dot_product"])
def test_all_capacities_hold_and_bins_are_few(score):
    r = random.Random(5)
    counts = collections.Counter(r.randint(1, 1024) for _ in range(5000))
    for cap in (packing.Capacity(score=score), packing.Capacity(documents=3, score=score), packing.Capacity(cost=700_000 + 1024 * 512, score=score)):
        bins = packing.pack_lengths(counts, cap)
        back = collections.Counter()
        for content, n in bins:
            assert sum(content) <= cap.tokens and len(content) <= cap.documents and sum(x * x for x in content) <= cap.cost
            for x in content:
                back[x] += n
        assert back == counts
    bins = packing.pack_lengths(counts, packing.Capacity(score=score))
    assert sum(n for _, n in bins) <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 1024) + 1
    with pytest.raises(ValueError):
        packing.pack_lengths({2000: 1})


def test_ids_equal_an_untouched_tokenizer():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    ids, untouched = packing.Ids(path), Tokenizer.from_file(path)
    r = random.Random(1)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", "Two words", "é", "  ", "12"]
    texts = ["one <|endoftext|> two", *("".join(r.choices(parts, k=8)) for _ in range(300))]
    for t in texts:
        assert ids(t) == np.array(untouched.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert 50256 in np.frombuffer(ids(texts[0]), "<u4")


def test_ids_equal_the_library_over_all_of_unicode():
    """Thousands of strings: of each general category, mixed, and long runs of one character."""
    import sys
    import unicodedata

    ids = packing.Ids(packing.vocabulary_path())
    assert ids.fast is not None
    by = collections.defaultdict(list)
    for c in range(sys.maxunicode + 1):
        by[unicodedata.category(chr(c))].append(chr(c))
    del by["Cs"]
    r = random.Random(3)
    texts = ["".join(r.choices(chars, k=r.randint(1, 30))) for chars in by.values() for _ in range(60)]
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts += ["".join(r.choice(r.choice([*by.values(), blanks, list("ab 's're1"), blanks])) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    texts += [c * 20_000 for c in (" ", "a", "\n", "é", "1", "=", "\t ")]
    for t, e in zip(texts, ids.encoder.encode_batch(texts, add_special_tokens=False)):
        assert ids(t) == np.array(e.ids, "<u4").tobytes(), t[:80]


def test_other_vocabularies_go_to_the_library():
    import public_tokenizers

    assert packing.Ids(public_tokenizers.path("word_bpe_49k.json")).fast is None


def test_tiny_documents_fill_whole_sequences(spark):
    """Ten thousand documents without a text are an end mark each, 1024 to a sequence."""
    empty = spark.range(10_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    assert packing.pack(empty).select("sequence_id").distinct().count() == 10


def test_op2_is_the_operator_on_the_whole_table(spark):
    """The registered query against the library, cut and laid out by the contract."""
    sf = "/root/testdata/sf0.001"
    got = packing.op2(spark, sf).collect()
    encoder = packing.Ids(packing.vocabulary_path()).encoder
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024
        cuts = ([(0, head)] if head else []) + [(s, s + 1024) for s in range(head, len(ids), 1024)]
        for k, (a, b) in enumerate(cuts):
            want[(r.doc_id, k)] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert len(got) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(sequences) <= 1.02 * sum(n for _, n, _ in want.values()) / 1024 + 1
