import collections
import unicodedata
import zlib

import numpy as np

from tidelog.llm import language_id

from .helpers import awkward, docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op6(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_awkward(spark):
    rows = awkward([(100 + k, "der die und nicht " * 9, "de", "s", 1, "q", "x", 1)[:2] for k in range(20)])
    got = language_id.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (6, 7, 8):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[None].held_out and all(r.lang_pred in ("en", "de", "und") for r in got)


def test_no_labels_and_empty(spark):
    rows = [(1, "words here", None, None, None, "q", "x", 1)]
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs(spark, rows)).collect()] == [("und", 0.0)]
    assert language_id.identify(docs(spark, [])).count() == 0


def test_families_and_pairs():
    g = np.random.default_rng(0)
    base = {k: g.random(language_id.DIMENSION).astype(np.float32) for k in ("de", "en", "fr", "es", "qq")}
    x = np.array([base[k] / np.linalg.norm(base[k]) for k in base for _ in range(5)], np.float32)
    model = language_id.Model.fit(x, [k for k in base for _ in range(5)])
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "other": ["qq"]}
    assert set(model.pairs) == {("germanic", "other"), ("germanic", "romance"), ("other", "romance"), ("de", "en"), ("es", "fr")}
    for k in base:
        lang, score = model.predict((base[k] / np.linalg.norm(base[k]))[None, :])[0]
        assert lang == k and 0 < score <= 1


def plain_features(text):
    """Counts of hashed 2-, 3- and 4-byte substrings in plain Python."""
    import math
    import re

    data = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", f" {text.lower()} ".encode())
    total = [0] * language_id.DIMENSION
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            total[((int.from_bytes(data[i : i + n], "big") * 2654435761 + n * 40503) % (1 << 32)) >> 19] += 1
    norm = math.sqrt(sum(total)) or 1.0
    return [math.sqrt(x) / norm for x in total]


def plain_predict(model, text):
    """Families first, then languages: each pair votes for the sign of its margin."""
    import math

    if text is None or not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    x = plain_features(text)
    margin = {p: sum(float(a) * b for a, b in zip(w[:-1], x)) + float(w[-1]) for p, w in zip(model.pairs, model.weights)}
    score, names = 1.0, sorted(model.families)
    for _ in range(2):
        own = {n: [m if p[0] == n else -m for p, m in margin.items() if n in p and set(p) <= set(names)] for n in names}
        best = sorted(names, key=lambda n: (-sum(m > 0 for m in own[n]), -sum(own[n])))[0]
        score *= sum(1 / (1 + math.exp(-2 * m)) for m in own[best]) / len(own[best]) if own[best] else 1.0
        names = model.families.get(best, [])
    return best, score


def test_predictions_equal_a_plain_version(spark):
    """Features, votes and the contract's fields of every row, on a model that training gave."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    texts = ["² ½ ①", "Ⅷ", "_", "123 ,.", "ª", "漢字", "x", "Ünï çödé", "a\x00b", "der die das und", "\u0301"]
    more = spark.createDataFrame([*((-k, t, "qq") for k, t in enumerate(texts, 1)), (None, "le la les", None), (7, None, "en")], table.schema)
    rows = table.unionByName(more)
    model = language_id.train(rows)
    assert len(model.families) > 1 and max(map(len, model.families.values())) > 1
    shown = rows.where("length(text) < 3000 or text is null").collect()
    got = language_id.identify(rows).where("doc_id is null or doc_id < 100000").collect()
    assert len(got) == rows.count()
    want = sorted(((r.doc_id, zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0, *plain_predict(model, r.text)) for r in shown), key=str)
    wanted = {r.doc_id for r in shown}
    found = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in got if r.doc_id in wanted), key=str)
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert max(abs(a[3] - b[3]) for a, b in zip(found, want)) < 1e-4
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[-k] for k in (1, 2, 3, 4)] == ["und"] * 4 and all(by[-k] != "und" for k in (5, 6, 7, 8))


def test_the_sample_is_bounded_and_holds_no_held_out_row(spark, monkeypatch):
    """Many rows of one id and text, many of one id, and ordinary ones: at most the sample of each language is collected."""
    seen = []
    fit = language_id.Model.fit
    monkeypatch.setattr(language_id.Model, "fit", staticmethod(lambda x, langs: (seen.append(collections.Counter(langs)), fit(x, langs))[1]))
    rows = [(1, "same text here", "de")] * 300 + [(2, f"one id {k}", "de") for k in range(300)] + [(k, f"row number {k} of these", "en") for k in range(600)]
    rows += [(k, "verboten", "xx") for k in range(5000) if zlib.crc32(str(k).encode()) % 5 == 0]
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50)
    assert len(seen) == 1 and set(seen[0]) == {"de", "en"} and 25 <= min(seen[0].values()) and max(seen[0].values()) <= 50
