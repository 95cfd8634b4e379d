"""Toxic spans by a linear-chain conditional random field, document scores and offending offsets.

Tokens are runs of letters, in lower case. Labels exist for documents only, so token labels are derived: a word form or word
beginning that toxic learning documents hold far more often than others marks its tokens in toxic documents as toxic; all other
tokens, and every token of a clean document, are not. On these labelled tokens a chain of two states (clean, toxic) is
trained; its token features are the word and its beginnings, as far as they were found telling.

Forward-backward gives each token its marginal. Tokens without any feature all have the same potentials, so a run of g of
them is one step with the g-th power of a two-by-two matrix, exactly; a document costs a lookup for each word and a few
operations for each token that has a feature. The score combines the marginals (the chance that at least one token is toxic, and the
largest marginal) by a logistic fit on the learning documents.

Learning takes at most MAX_DOCS labelled documents with remainder 0 or 2 (those with the smallest hash of their id), a parameter. Scoring covers
every document in one pass without a shuffle. Labels, lang, source and doc_id are never features.

Defined cases: a NULL, empty or letterless text has the score of a document without toxic tokens; rows with NULL ids or labels are never
learned from; without labels of both classes nothing is toxic; repeated rows are scored one by one; an empty table gives
an empty result; columns other than doc_id and text are passed through by `keep` and not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import CACHE_ENTRIES, bounded_sample, cut, one_per_id, remainder, table

MAX_DOCS = 12_000
TOXIC_FROM = 0.7
BEGINNINGS = range(3, 8)
LEAST_G = 15.0  # log-likelihood ratio of a telling feature
LEAST_LIFT = 3.0
LEAST_DOCS = 3
MARGIN = 3  # featureless tokens kept around telling ones in training
LONGEST = 40
STEPS = 150
RIDGE = 0.02
LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k <= len(word))]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, found in the text as it is: the k-th is the k-th match of LETTERS, whatever lower-casing does to lengths."""
    if not text:
        return []
    if "\u0130" not in text:  # the only letter that more than one character replaces
        return LETTERS.findall(text.lower())
    return [w.lower() for w in LETTERS.findall(text)]


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class Chain:
    """States 0 (clean) and 1 (toxic). Potentials: transitions, and for state 1 bias plus the token's weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # 00, 01, 10, 11
    fit: tuple[float, float, float] = (-4.0, 0.0, 0.0)  # constant, noisy-or, largest marginal

    def __post_init__(self):
        self.cache: dict[str, float] = {}
        e00, e01, e10, e11 = (math.exp(m) for m in self.moves)
        self.e = (e00, e01, e10, e11)
        u = math.exp(self.bias)
        a, b, c, d = e00, e01 * u, e10, e11 * u  # a step onto a featureless token
        root = math.sqrt((a - d) ** 2 + 4 * b * c)
        top, low = (a + d + root) / 2, (a + d - root) / 2
        self.ratio = low / top
        self.main = tuple(x / (top - low) for x in (a - low, b, c, d - low))
        self.rest = tuple(x / (low - top) for x in (a - top, b, c, d - top))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "moves": self.moves, "fit": self.fit}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def power(self, g: int) -> tuple[float, float, float, float]:
        """The g-th power of a featureless step, up to scale."""
        r = self.ratio**g
        return tuple(m + r * n for m, n in zip(self.main, self.rest, strict=True))

    def weight(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            found = sum(self.weights.get(f, 0.0) for f in features_of(word))
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[word] = found
        return found

    def marginals(self, places: list[int], weights: list[float], n: int) -> list[float]:
        """Probability of state 1 at the given token places of n; all other tokens are featureless."""
        if not places:
            return []
        e00, e01, e10, e11 = self.e
        u = math.exp(self.bias)
        psi = [math.exp(min(60.0, self.bias + w)) for w in weights]
        forward, last = [], -1
        x = y = 1.0
        for at, p in zip(places, psi, strict=True):
            gap = at - last - 1
            if last < 0:
                if gap:
                    a, b, c, d = self.power(gap - 1)
                    x, y = a + u * c, b + u * d
                    x, y = x * e00 + y * e10, (x * e01 + y * e11) * p
                else:
                    x, y = 1.0, p
            else:
                if gap:
                    a, b, c, d = self.power(gap)
                    x, y = x * a + y * c, x * b + y * d
                x, y = x * e00 + y * e10, (x * e01 + y * e11) * p
            s = x + y
            x, y = x / s, y / s
            forward.append((x, y))
            last = at
        out = [0.0] * len(places)
        x = y = 1.0
        after = n
        for k in range(len(places) - 1, -1, -1):
            gap = after - places[k] - 1
            if after < n:
                x, y = e00 * x + e01 * psi[k + 1] * y, e10 * x + e11 * psi[k + 1] * y
            if gap:
                a, b, c, d = self.power(gap)
                x, y = a * x + b * y, c * x + d * y
            s = x + y
            x, y = x / s, y / s
            f = forward[k]
            out[k] = f[1] * y / (f[0] * x + f[1] * y)
            after = places[k]
        return out

    def tokens(self, text: str | None) -> tuple[list[int], list[float], int]:
        words = words_of(text)
        found = [(i, w) for i, w in enumerate(map(self.weight, words)) if w]
        return [i for i, _ in found], [w for _, w in found], len(words)

    def evidence(self, p: list[float]) -> tuple[float, float]:
        clean = sum(math.log1p(-min(x, 1 - 1e-9)) for x in p)
        largest = max(p, default=0.0)
        return min(-clean, 12.0), largest

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """Document score, places of featured tokens and their marginals."""
        places, weights, n = self.tokens(text)
        p = self.marginals(places, weights, n)
        some, largest = self.evidence(p)
        z = self.fit[0] + self.fit[1] * some + self.fit[2] * largest
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), places, p

    def spans(self, text: str, places: list[int], p: list[float], least: float = 0.5) -> list[tuple[int, int]]:
        """Offsets (begin, end in characters of the text) of tokens whose marginal reaches `least`."""
        wanted = {i for i, x in zip(places, p, strict=True) if x >= least}
        if not wanted:
            return []
        return [m.span() for i, m in enumerate(LETTERS.finditer(text)) if i in wanted]


def telling(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Features that toxic documents hold significantly more often, with the share of toxic ones among their documents."""
    out = {}
    for f, (a, b) in counts.items():
        if a < LEAST_DOCS or (a + 0.5) * clean < LEAST_LIFT * (b + 0.5) * toxic:
            continue
        c, d, n = toxic - a, clean - b, toxic + clean
        g = 0.0
        for seen, row, col in ((a, a + b, toxic), (b, a + b, clean), (c, c + d, toxic), (d, c + d, clean)):
            if seen:
                g += 2 * seen * math.log(seen * n / (row * col))
        if g >= LEAST_G:
            out[f] = (a + 0.5) / (a + b + 1)
    return out


@dataclass
class Labelled:
    """Token sequences, flat: tokens in each sequence, then for each token its label and number of features, then features."""

    lengths: np.ndarray
    marks: np.ndarray
    counts: np.ndarray
    features: np.ndarray

    @staticmethod
    def of(sequences: list[tuple[list[list[int]], list[int]]]) -> Labelled:
        tokens = [fs for feats, _ in sequences for fs in feats]
        return Labelled(
            np.array([len(m) for _, m in sequences], "<i4"),
            np.array([x for _, m in sequences for x in m], "<i1"),
            np.array([len(fs) for fs in tokens], "<i1"),
            np.array([f for fs in tokens for f in fs], "<i4"),
        )

    @staticmethod
    def join(parts: list[Labelled]) -> Labelled:
        names = ("lengths", "marks", "counts", "features")
        return Labelled(*(np.concatenate([getattr(p, n) for p in parts]) for n in names))

    def weights(self, values: np.ndarray) -> np.ndarray:
        """The sum of each token's feature weights."""
        token = np.repeat(np.arange(len(self.counts)), self.counts)
        return np.bincount(token, values[self.features], minlength=len(self.counts))


def train(data: Labelled, size: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions that maximise the labels' likelihood, by full-batch resilient steps.

    Sequences are sorted from the longest; the tokens at place t of all that reach it lie together.
    """
    many, total = len(data.lengths), len(data.marks)
    if not total:
        return np.zeros(size), -8.0, np.zeros((2, 2))
    order = np.argsort(-data.lengths, kind="stable")
    rank = np.empty(many, np.int64)
    rank[order] = np.arange(many)
    longest = int(data.lengths.max())
    live = [int((data.lengths > t).sum()) for t in range(longest)]
    off = np.concatenate([[0], np.cumsum(live)])
    place = np.arange(total) - np.repeat(np.cumsum(data.lengths) - data.lengths, data.lengths)
    index = off[place] + np.repeat(rank, data.lengths)
    labels = np.empty(total, np.int64)
    labels[index] = data.marks
    rows, cols = np.repeat(index, data.counts), data.features
    at = [slice(int(off[t]), int(off[t]) + live[t]) for t in range(longest)]
    kept = [slice(int(off[t - 1]), int(off[t - 1]) + live[t]) for t in range(1, longest)]  # those at t - 1 that go on
    seen = np.bincount(cols, labels[rows], minlength=size)
    seen_moves = np.zeros((2, 2))
    for t in range(1, longest):
        np.add.at(seen_moves, (labels[kept[t - 1]], labels[at[t]]), 1)
    theta = np.concatenate([np.zeros(size), [-2.0], np.zeros(4)])
    step, old = np.full(len(theta), 0.1), np.zeros(len(theta))
    forward, back = np.empty((total, 2)), np.empty((total, 2))
    for _ in range(STEPS):
        weights, bias, moves = theta[:size], theta[size], theta[size + 1 :].reshape(2, 2)
        psi = np.exp(np.clip(np.bincount(rows, weights[cols], minlength=total) + bias, -50, 50))
        e = np.exp(np.clip(moves, -20, 20))
        forward[at[0], 0], forward[at[0], 1] = 1, psi[at[0]]
        forward[at[0]] /= forward[at[0]].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            x = forward[kept[t - 1]] @ e
            x[:, 1] *= psi[at[t]]
            forward[at[t]] = x / x.sum(axis=1, keepdims=True)
        want_moves = np.zeros((2, 2))
        back[:] = 1
        for t in range(longest - 1, 0, -1):
            y = back[at[t]].copy()
            y[:, 1] *= psi[at[t]]
            pair = forward[kept[t - 1], :, None] * e[None] * y[:, None, :]
            want_moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            x = y @ e.T
            back[kept[t - 1]] = x / x.sum(axis=1, keepdims=True)
        p = forward[:, 1] * back[:, 1]
        p /= p + forward[:, 0] * back[:, 0]
        slope = np.concatenate(
            [
                seen - np.bincount(cols, p[rows], minlength=size),
                [labels.sum() - p.sum()],
                (seen_moves - want_moves).ravel(),
            ]
        )
        slope -= RIDGE * max(1.0, many / 100) * theta * np.concatenate([np.ones(size), [0.0], np.full(4, 1.0)])
        same = np.sign(slope) * np.sign(old)
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        slope[same < 0] = 0
        theta = theta + np.sign(slope) * step
        old = slope
    return theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton steps with a small ridge; a constant comes first."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        curve = design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + 0.1 * np.eye(len(w))
        move = np.linalg.solve(curve, design.T @ (y - p) - 0.1 * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    marks = labels.where(F.col("toxic").isNotNull() & (remainder("doc_id", 3) != 1))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(bounded_sample(marks, "doc_id", max_docs))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    return one_per_id(found).select("doc_id", "text", "toxic")


def count_features(rows: DataFrame) -> DataFrame:
    """feature, toxic and clean: in how many learning documents of each kind a feature occurs, summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = set(words_of(text))
                counts[int(toxic == 1)].update({f for w in words for f in features_of(w)})
            keys = list(counts[0].keys() | counts[1].keys())
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "feature": part,
                        "toxic": pa.array([counts[1][k] for k in part], pa.int64()),
                        "clean": pa.array([counts[0][k] for k in part], pa.int64()),
                    }
                )

    parts = rows.mapInArrow(run, "feature string, toxic long, clean long")
    sums = parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return sums.where(F.col("toxic") >= LEAST_DOCS)


def _windows(text: str | None, toxic: int, number: dict[str, int], strong: set[str]) -> list[tuple[list, list]]:
    """Labelled token sequences around tokens with a feature."""
    words = words_of(text)
    names = [[f for f in features_of(w) if f in number] for w in words]
    held = [i for i, fs in enumerate(names) if fs]
    out, begin = [], None
    for k, i in enumerate(held):
        begin = max(0, i - MARGIN) if begin is None else begin
        end = min(len(words), i + MARGIN + 1)
        if k + 1 < len(held) and held[k + 1] - MARGIN <= end and end - begin < LONGEST:
            continue
        part = names[begin:end]
        marks = [int(toxic == 1 and any(f in strong for f in fs)) for fs in part]
        out.append(([[number[f] for f in fs] for fs in part], marks))
        begin = None
    return out


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Chain:
    rows = cut(_labelled(docs, labels, max_docs))  # at most max_docs texts, read three times
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Chain()
    counted = count_features(rows).where(
        (F.col("toxic") + 0.5) * clean >= LEAST_LIFT * (F.col("clean") + 0.5) * toxic
    )  # fewer features than the bounded sample has telling ones come to the driver
    shares = telling({r["feature"]: (r["toxic"], r["clean"]) for r in counted.collect()}, toxic, clean)
    names = sorted(shares)
    number, strong = {f: i for i, f in enumerate(names)}, {f for f in names if shares[f] >= 0.5}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [Labelled.of(_windows(t, m, number, strong)) for t, m in zip(texts, marks, strict=True)]
            cols = [[getattr(x, n).tobytes() for x in found] for n in ("lengths", "marks", "counts", "features")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, pa.binary()) for c in cols)],
                names=["doc_id", "toxic", "lengths", "marks", "counts", "features"],
            )

    kinds = "doc_id long, toxic int, lengths binary, marks binary, counts binary, features binary"
    learned = sorted(rows.mapInArrow(run, kinds).collect(), key=lambda r: (r["doc_id"], r["features"]))  # bounded by max_docs
    parts = [
        Labelled(*(np.frombuffer(r[n], k) for n, k in (("lengths", "<i4"), ("marks", "<i1"), ("counts", "<i1"), ("features", "<i4"))))
        for r in learned
    ]
    weights, bias, moves = train(Labelled.join(parts), len(names))
    chain = Chain({f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-6}, bias, tuple(moves.ravel().tolist()))
    evidence = []
    for part in parts:
        p, begin, sums = [], 0, part.weights(weights)
        for n in part.lengths.tolist():
            at = np.flatnonzero(part.counts[begin : begin + n]).tolist()
            p += chain.marginals(at, [float(sums[begin + i]) for i in at], n)
            begin += n
        evidence.append(chain.evidence(p))
    fit = logistic(np.array(evidence), np.array([r["toxic"] for r in learned], float))
    return Chain(chain.weights, chain.bias, chain.moves, tuple(float(x) for x in fit))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.7) and spans (offsets of offending tokens) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            scores, spans = [], []
            for value in batch.column(1):
                text = value.as_py()
                s, places, p = chain.score(text)
                scores.append(s)
                spans.append([{"begin": a, "end": b} for a, b in chain.spans(text or "", places, p)])
            s = np.array(scores, float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(s, pa.float64()),
                    pa.array((s >= TOXIC_FROM).astype(np.int32)),
                    pa.array(spans, spans_type),
                ],
                names=["doc_id", "score", "predicted", "spans"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<begin: long, end: long>>")


def keep(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents that score below the limit, with all their columns."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [chain.score(t.as_py())[0] < TOXIC_FROM for t in batch.column(text)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", "predicted", "spans")
