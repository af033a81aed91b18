"""Fixtures of documents with the awkward cases, and slow, plain versions of the operators."""

import collections
import hashlib
import random
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, _id string, hits long"


def prose(n, seed, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 8))) for _ in range(words)]
    out = []
    while len(out) < n:
        k = r.randint(6, 14)
        out += [" ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + "."]
    return out


def awkward(extra=()):
    """Rows with nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    a = " ".join(prose(30, 1)) + "\n" + " ".join(prose(20, 2))
    b = "\n".join(prose(40, 3))
    texts = [(1, a), (2, a), (3, a.replace(" ", "  ")), (4, b), (5, b[:-40] + "Changed end of it here."), (6, ""), (7, None), (8, " \n\t "), (9, "short"), (9, "short"), (None, b), (10, "é" * 50 + "\x00  ß 漢字 🙂 " * 5), (11, "\n".join(prose(1500, 4)))]
    texts += list(extra)
    rows = [(i, t, None if k % 5 == 4 else ("en", "de")[k % 2], None if k % 4 == 3 else f"s{k % 2}", None if k % 6 == 5 else len(t or ""), "q", "x", 1) for k, (i, t) in enumerate(texts)]
    return rows


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(t):
    return WORD.findall(t or "")


def fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(n)]


def repeats(texts, length=200):
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        rest = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out
