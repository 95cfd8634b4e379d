"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document becomes a sparse vector: a share for each hashed distinct word, one-hot bins of statistics of its characters, lines and
words, and bins of its metadata (n_chars, where the table has it). The machine adds to the linear score the pairwise
interactions sum_ij <v_i, v_j> x_i x_j, in time linear in the features by 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Learning takes at most MAX_DOCS labelled documents with remainder 0 or 2 (the ones with the smallest hash of their id):
the one bound on rows, and a parameter. Their vectors, not their texts, come to the driver. Scoring covers every document and is a
single pass without a shuffle. Labels, lang, source and doc_id are never features.

Defined cases: a NULL or empty text is scored from its statistics (all zero) like any other; NULL metadata has a bin of its
own; rows with NULL ids or labels are never learned from; without labels of both classes everything scores the class
share, 0.5 without any label; repeated rows are scored one by one; an empty table gives an empty result; columns other than doc_id, text and
n_chars are passed through by `keep` and not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import CACHE_ENTRIES, WORD, bounded_sample, one_per_id, remainder, table

MAX_DOCS = 12_000
WORD_BUCKETS = 1 << 14
BINS = 12
FACTORS = 4
EPOCHS = 12
STEP = 0.1
LINEAR_DECAY, FACTOR_DECAY = 1e-4, 1e-3
#: Statistics in [0, 1], in this order; the bins are even on the square root.
STATISTICS = (
    "signs", "upper", "digits", "bars", "exclamations", "spaces", "repeated_words", "repeated_pairs", "ended_lines",
    "repeated_lines", "short_lines", "commas", "stops", "marked_words",
)
COUNTS = ("words", "word_length", "line_words", "n_chars")
PLACES = {name: WORD_BUCKETS + BINS * i for i, name in enumerate(STATISTICS + COUNTS)}
DIMENSION = WORD_BUCKETS + BINS * len(PLACES)
_SIGNS = [ord(c) for c in "#*$%&<>@^~=+_{}"]
_words: dict[str, int] = {}


def bucket(word: str) -> int:
    """Stable hash of a word; a bounded cache spares the repeated ones."""
    found = _words.get(word)
    if found is None:
        found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        if len(_words) >= CACHE_ENTRIES:
            _words.clear()
        _words[word] = found
    return found


def statistics(text: str, words: list[str], distinct: int) -> dict[str, float]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    pairs = len(set(zip(words, words[1:], strict=False)))
    marked = sum(hist[c] for c in (*_SIGNS, ord("!"), ord("|"), ord(".")))
    return {
        "signs": hist[_SIGNS].sum() / size,
        "upper": hist[65:91].sum() / max(1, hist[65:91].sum() + hist[97:123].sum()),
        "digits": hist[48:58].sum() / size,
        "bars": hist[124] / n,
        "exclamations": hist[33] / n,
        "spaces": hist[32] / size,
        "repeated_words": 1 - distinct / n if words else 0.0,
        "repeated_pairs": 1 - pairs / (n - 1) if len(words) > 1 else 0.0,
        "ended_lines": sum(x.rstrip()[-1] in ".!?…\"'”»)" for x in lines) / m,
        "repeated_lines": 1 - len(set(lines)) / m,
        "short_lines": sum(len(x) < 30 for x in lines) / m,
        "commas": min(1.0, hist[44] / n),
        "stops": min(1.0, hist[46] / n),
        "marked_words": min(1.0, marked / n / 4),
    }


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's vector. The words' squared values add up to one, as do the bins'."""
    text = text or ""
    words = WORD.findall(text)
    kinds = set(words)
    found = np.unique(np.fromiter(map(bucket, kinds), np.int64, len(kinds)))
    stats = statistics(text, words, len(kinds))
    places = [PLACES[k] + min(BINS - 1, int(BINS * v**0.5)) for k, v in stats.items()]
    lines = text.count("\n") + 1
    for name, value in (("words", len(words)), ("word_length", len(text) / max(1, len(words))), ("line_words", len(words) / lines)):
        places.append(PLACES[name] + min(BINS - 1, int(np.log2(1 + value))))
    places.append(PLACES["n_chars"] + (0 if n_chars is None else 1 + min(BINS - 2, int(np.log2(1 + max(0, n_chars)) / 2))))
    index = np.concatenate([found, places])
    value = np.empty(len(index))
    value[: len(found)] = 1 / max(1, len(found)) ** 0.5
    value[len(found) :] = 1 / len(places) ** 0.5
    return index, value


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index]
        total = value @ v
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - (value * value) @ (v * v).sum(axis=1)))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.margin(index, value), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """Logistic loss, one document at a time with adaptive steps; the classes weigh the same."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(DIMENSION), rng.normal(0, 0.05, (DIMENSION, FACTORS)))
    good = sum(y for _, _, y in rows)
    if good in (0, len(rows)):
        machine.bias = 0.0 if not rows else (4.0 if good else -4.0)
        machine.factors[:] = 0
        return machine
    weight = (len(rows) / (2 * (len(rows) - good)), len(rows) / (2 * good))
    bias_sum, linear_sum, factor_sum = 1e-6, np.full(DIMENSION, 1e-6), np.full((DIMENSION, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            index, value, y = rows[k]
            v = machine.factors[index]
            total = value @ v
            g = weight[y] * (machine.score(index, value) - y)
            bias_sum += g * g
            machine.bias -= STEP * g / bias_sum**0.5
            step = g * value + LINEAR_DECAY * machine.linear[index]
            linear_sum[index] += step * step
            machine.linear[index] -= STEP * step / np.sqrt(linear_sum[index])
            slope = g * (value[:, None] * total - (value * value)[:, None] * v) + FACTOR_DECAY * v
            factor_sum[index] += slope * slope
            machine.factors[index] -= STEP * slope / np.sqrt(factor_sum[index])
    return machine


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Machine:
    """Fit on at most `max_docs` labelled documents whose remainder is not 1; of rows with the same id, on one."""
    marks = labels.where(F.col("quality").isNotNull() & (remainder("doc_id", 3) != 1))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = F.broadcast(bounded_sample(marks, "doc_id", max_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
                    batch.column(3),
                ],
                names=["doc_id", "places", "amounts", "quality"],
            )

    chosen = one_per_id(_inputs(docs).join(sample, "doc_id")).select("doc_id", "text", "n_chars", "quality")
    rows = chosen.mapInArrow(run, "doc_id long, places binary, amounts binary, quality int")
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["places"], r["amounts"]))  # bounded by max_docs
    return fit(
        [
            (np.frombuffer(r["places"], "<i4").astype(np.int64), np.frombuffer(r["amounts"], "<f4").astype(float), r["quality"])
            for r in found
        ]
    )


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([machine.score(*features(t.as_py(), n.as_py())) for t, n in zip(batch.column(1), batch.column(2), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return _inputs(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents with predicted quality 1, with all their columns."""
    schema, text = docs.schema, docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(chars) if chars is not None else [pa.scalar(None)] * batch.num_rows
            good = [machine.score(*features(t.as_py(), k.as_py())) >= 0.5 for t, k in zip(batch.column(text), n, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted")
