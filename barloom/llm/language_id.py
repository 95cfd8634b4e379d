"""Hierarchical language identification: family first, then linear support vector machines within the family.

A text becomes the square roots of the shares of its hashed byte trigrams (letters in lower case, everything else a space). One-versus-rest
linear machines choose the family; within a family of several languages, one-versus-one machines between its languages vote by
their margins. All machines minimise the squared hinge loss with a ridge.

Learning takes about PER_LANGUAGE documents of each language with remainder 0, 1 or 3 (those whose hashed id falls under
a threshold set from the language's count), a parameter. Their trigram counts, not their texts, come to the driver. Scoring covers every
whole text in one pass without a shuffle; lang, source and doc_id are never inputs.

Defined cases: a text that is NULL or holds no letter is `und` with score 0; with no learned language every text is
`und`; a language of no listed family is a family by itself; rows with a NULL lang or id are not learned from; repeated rows are scored one by one; an empty
table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import remainder, table

#: Families of common languages by code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "sinitic": ("zh", "yue"),
    "indic": ("hi", "bn", "mr", "ur"),
}
PER_LANGUAGE = 500
DIMENSION = 4096
CHUNK = 1 << 20
STEPS = 150
RIDGE = 1e-4
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters count as spaces.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams, over the whole text in chunks."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(TO_SPACE) + b" "
    out = np.zeros(DIMENSION, np.int64)
    for at in range(0, len(raw) - 2, CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        out += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=DIMENSION)
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / max(1, counts.sum()))


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the constant, by accelerated gradient steps; classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    sign = np.where(y, 1.0, -1.0).astype(x.dtype)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(x.dtype)
    w = z = np.zeros(x.shape[1], x.dtype)
    rate = 0.25  # rows have norm sqrt(2), so the curvature is at most 4
    for k in range(STEPS):
        slack = np.maximum(0, 1 - sign * (x @ z))
        slope = np.float32(-2) * ((weight * sign * slack) @ x) + np.float32(RIDGE) * z
        new = z - np.float32(rate) * slope
        z = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w.astype(float)


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    family: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not LETTER.search(text):
            return "und", 0.0
        x = np.append(shares(trigrams(text)), 1.0)
        names = sorted(self.families)
        margins = np.array([x @ self.family[f] for f in names]) if len(names) > 1 else np.zeros(1)
        p = np.exp(3 * (margins - margins.max()))
        best = int(np.argmax(margins))
        sure = float(p[best] / p.sum())
        langs = self.families[names[best]]
        if len(langs) == 1:
            return langs[0], sure
        votes = dict.fromkeys(langs, 0.0)
        for (a, b), w in self.pairs.items():
            if a in votes and b in votes:
                share = float(1 / (1 + np.exp(-3 * (x @ w))))
                votes[a] += share
                votes[b] += 1 - share
        lang = max(langs, key=lambda name: (votes[name], name))
        return lang, sure * votes[lang] / (len(langs) - 1)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def fit(x: np.ndarray, langs: list[str]) -> Model:
    kinds = np.array([family_of(lang) for lang in langs], object)
    names = np.array(langs, object)
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    model = Model(families)
    for f in families if len(families) > 1 else ():
        model.family[f] = svm(x, kinds == f)
    for members in families.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows = (names == a) | (names == b)
                model.pairs[a, b] = svm(x[rows], names[rows] == a)
    return model


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))  # an id on many rows is sampled row by row
    limit = F.lit(0)
    for lang, n in sizes.items():
        share = min(1.0, per_language / n if n > 1 else 1.0)
        limit = F.when(F.col("lang") == lang, F.lit(int(share * (1 << 20)))).otherwise(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trigrams(t) for t in batch.column(2).to_pylist()]
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()),
                    pa.array([c[i].astype("<i4").tobytes() for c, i in zip(found, at, strict=True)], pa.binary()),
                ],
                names=["doc_id", "lang", "places", "counts"],
            )

    rows = known.where(place < limit).mapInArrow(run, "doc_id long, lang string, places binary, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["counts"]))
    if not rows:
        return Model()
    x = np.zeros((len(rows), DIMENSION), np.float32)
    for i, r in enumerate(rows):
        counts = np.frombuffer(r["counts"], "<i4")
        x[i, np.frombuffer(r["places"], "<u2")] = np.sqrt(counts / max(1, counts.sum()))
    return fit(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([a for a, _ in found], pa.string()),
                    pa.array([b for _, b in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
