"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams of the whole text; nothing else of a row is read by a prediction. Models are
linear SVMs trained here, on a sample of labelled rows: at most ``sample_per_language`` of each language, those with the
least hash of id and text, none of them held out, and rows that agree in both once.

Defined cases: null text, or text without a letter (a character of Unicode's categories L), is ``und`` with score 0; a null id counts as the empty
string and is thereby held out; a label without training rows is never predicted; without any training row all
is ``und``; a family of one language needs no SVM; labels outside the family table share the family ``other``;
ties go to the label that sorts first; repeated rows agree; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import spread

DIMENSION = 1 << 13
SAMPLE_PER_LANGUAGE = 400
FOLDS = 5
UNKNOWN = "und"

#: Families of language codes (fixed values).
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn nb no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt",
    "turkic": "az kk tr uz",
    "uralic": "et fi hu",
    "sinitic": "yue zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id ms tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Texts whose features are multiplied at once.
BLOCK = 256
_FOLD = np.array([c if chr(c).isalpha() or c > 127 else 32 for c in range(256)], np.uint8)


def family_of(lang: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], "other")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """Square roots of hashed counts of 2-, 3- and 4-byte substrings, lower case, with unit norm."""
    data = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    data = data[np.append(True, (data[1:] != 32) | (data[:-1] != 32))]  # runs of blanks are one
    total = np.zeros(DIMENSION)
    gram = data
    for n in (2, 3, 4):
        gram = gram[:-1] << np.uint32(8) | data[n - 1 :]
        if not len(gram):
            break
        total += np.bincount((gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(19), minlength=DIMENSION)
    total = np.sqrt(total)
    return (total / (np.linalg.norm(total) or 1.0)).astype(np.float32)


def svm(x: np.ndarray, positive: np.ndarray, epochs: int = 12, strength: float = 1e-4) -> np.ndarray:
    """Weights, the last for a constant 1, of a linear SVM by averaged stochastic subgradients; classes count alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0)
    cost = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * len(y)
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    order = np.random.default_rng(11)
    for epoch in range(epochs):
        for i in order.permutation(len(y)):
            step += 1
            rate = 1 / (strength * (step + 1000))
            margin = y[i] * (x[i] @ w)
            w *= 1 - rate * strength
            if margin < 1:
                w += rate * strength * 10 * cost[i] * y[i] * x[i]
        if epoch >= epochs // 2:
            mean += w
    return (mean / max(1, epochs - epochs // 2)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Families, the languages of each, and a weight row for each pair of families and of languages in a family."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> "Model":
        names = sorted(set(langs))
        families: dict[str, list[str]] = {}
        for lang in names:
            families.setdefault(family_of(lang), []).append(lang)
        label, group = np.array(langs), np.array([family_of(x) for x in langs])
        pairs, weights = [], []
        for values, of in [(group, sorted(families)), *((label, members) for members in families.values())]:
            for a, b in itertools.combinations(of, 2):
                rows = (values == a) | (values == b)
                pairs.append((a, b))
                weights.append(svm(x[rows], values[rows] == a))
        return Model(families, pairs, np.array(weights, np.float32).reshape(len(pairs), DIMENSION + 1))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) for each row of features."""
        margins = (x @ self.weights[:, :-1].T + self.weights[:, -1]).tolist() if self.pairs else [[] for _ in x]
        out = []
        for own in margins:
            won = dict(zip(self.pairs, own))
            family, sure = self._vote(sorted(self.families), won)
            lang, surer = self._vote(self.families[family], won)
            out.append((lang, round(sure * surer, 5)))
        return out

    @staticmethod
    def _vote(names: list[str], margins: dict) -> tuple[str, float]:
        """The name with most won pairs, then the greatest sum of margins; and the mean chance of its pairs."""
        own = {n: [margins[p] if p[0] == n else -margins[p] for p in itertools.combinations(names, 2) if n in p] for n in names}
        best = max(names, key=lambda n: (sum(m > 0 for m in own[n]), sum(own[n])))
        chances = [1 / (1 + np.exp(-2 * min(max(m, -30), 30))) for m in own[best]]
        return best, float(np.mean(chances)) if chances else 1.0


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS) == 0


def _featured(batches):
    for batch in batches:
        langs, xs = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if has_letter(text):
                langs.append(lang)
                xs.append(features(text).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(xs, pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on at most that many rows of each language, none held out: those with the least hash of id and text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("hash", F.xxhash64(F.lit(31), "doc_id", "text"))
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return None
    # the least hashes of a language are among those below twice its share; each task passes on no more than the sample
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], 2.0 * sample_per_language / r["count"] + 0.001)])
    low = rows.where((F.shiftright("hash", 32) + F.lit(1 << 31)) / F.lit(float(1 << 32)) < share[F.col("lang")]).dropDuplicates(["lang", "hash"])
    place = F.row_number().over(W.partitionBy("lang").orderBy("hash"))
    chosen = low.withColumn("place", place).where(F.col("place") <= sample_per_language)
    found = chosen.select("lang", "text").mapInArrow(_featured, "lang string, x binary").collect()
    if not found:
        return None
    found = sorted(found, key=lambda r: (r["lang"], r["x"]))  # the order of partitions doesn't matter
    return Model.fit(np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float32), [r["lang"] for r in found])


def _predicted(model):
    """model: a broadcast Model, or None."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = part.column("text").to_pylist()
                good = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if good:
                    for i, (lang, score) in zip(good, model.value.predict(np.array([features(texts[i]) for i in good]))):
                        langs[i], scores[i] = lang, score
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(rows, sample_per_language)
    shared = None if model is None else docs.sparkSession.sparkContext.broadcast(model)  # a weight row a pair of languages
    todo = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return todo.mapInArrow(_predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract query over all documents."""
    return identify(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")))
