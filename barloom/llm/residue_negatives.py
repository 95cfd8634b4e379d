"""Hard negatives by exact integer inner products, multiplied in a residue number system.

Components become floor(scale * x). Products are taken modulo several small odd primes with float32 matrix products: residues
lie within half a prime of zero, so a run of columns sums to less than 2^24 and float32 holds it exactly.
Chinese remaindering with signed mixed-radix digits gives the signed score back; there are as many primes as the largest
possible score (from the largest norm) needs. Scores that could leave 2^61 raise an error rather than wrap.

Anchors meet all rows in blocks: rows and anchors are dealt to blocks of bounded size by hash and a task takes one block of each. A
first pass keeps the best positives of each anchor and block, then of each anchor; their scores fix windows, and a second pass
keeps the best negatives inside each window in the same way.

Defined cases: rows with a NULL id, label or vector, or with a NULL or non-finite component take no part, nor do vectors of
another length than the most frequent one (the longer at a tie); rows that repeat an id are candidates each, but never
positives of an anchor with that id; of rows that repeat an anchor's id the one smallest by (label, vector) is
the anchor; ties go to the smaller id; an empty table gives an empty result; columns other than vec_id, label and embedding
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut

#: The largest primes of eight bits.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
EXACT = 1 << 24
MOST = 1 << 61
LEAST_BLOCK, MOST_BLOCK, CELLS, SPLIT = 1_024, 65_536, 8_000_000, 128
SCORES = 4_000_000  # scores held at once by a task
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Residues:
    """Exact signed inner products of integer matrices whose size is at most `largest`."""

    def __init__(self, largest: int):
        if largest >= MOST:
            raise ValueError("scores of these vectors may not fit a long")
        need, self.primes = 2 * largest + 1, []
        product = 1
        for p in PRIMES:
            self.primes.append(p)
            product *= p
            if product >= need:
                break
        self.run = EXACT // (max(self.primes) // 2) ** 2 - 1  # columns whose products sum up exactly

    @staticmethod
    def centre(x: np.ndarray, p: int) -> np.ndarray:
        return x - p * np.rint(x / p)

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return [self.centre(np.fmod(x, p), p).astype(np.float32) for p in self.primes]

    def product(self, a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
        p32, out = np.float32(p), np.zeros((len(a), len(b)), np.float32)
        for at in range(0, a.shape[1], self.run):
            part = a[:, at : at + self.run] @ b[:, at : at + self.run].T
            out += part - p32 * np.rint(part / p32)
            out -= p32 * np.rint(out / p32)
        return out

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """int64 matrix of a's rows against b's, from their residues."""
        digits: list[np.ndarray] = []
        value, weight = np.zeros((len(a[0]), len(b[0])), np.int64), 1
        for p, left, right in zip(self.primes, a, b, strict=True):
            rest = self.product(left, right, p)
            for q, digit in zip(self.primes, digits, strict=False):
                inverse = pow(q, -1, p)
                inverse -= p if inverse > p // 2 else 0
                rest = self.centre((rest - digit) * np.float32(inverse), np.float32(p))
            rest = self.centre(rest, np.float32(p))
            digits.append(rest)
            value += rest.astype(np.int64) * weight
            weight *= p
        return value


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties by the smaller id."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def valid_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and x of the rows that take part, whatever their length."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _blocks(n: int, width: int) -> int:
    size = min(max(n // SPLIT, LEAST_BLOCK), MOST_BLOCK, max(1, CELLS // max(width, 1)))
    return max(1, -(-n // size))


def _meet(rows: DataFrame, asked: DataFrame, parts: tuple[int, int], choose, schema: str) -> DataFrame:
    """Applies choose(rows, anchors) to every pair of a block of rows and a block of anchors."""
    left = rows.withColumn("i", F.pmod(F.xxhash64("vec_id", "x"), F.lit(parts[0])))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[1] - 1).cast("long"))))
    right = asked.withColumn("j", F.pmod(F.xxhash64("anchor_id"), F.lit(parts[1])))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[0] - 1).cast("long"))))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(choose, schema)


def _table(found: list[tuple], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*found, strict=True)) if found else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _scored(residues: Residues, scale: float, left: pa.Table, right: pa.Table):
    """For each anchor its place in the right table and its scores against all rows of the left one, block by block."""
    rows, asked = residues.split(_matrix(left.column("x"), scale)), residues.split(_matrix(right.column("x"), scale))
    step = max(1, SCORES // max(1, left.num_rows))
    for at in range(0, right.num_rows, step):
        values = residues.scores([m[at : at + step] for m in asked], rows)
        yield from enumerate(values, at)


def mine(
    embeddings: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    share: tuple[int, int, int] = (30, 90, 100),
    scale: float = 256.0,
) -> DataFrame:
    """The first negatives of every anchor (ids divisible by `every`) and each of its first positives, best first.

    A negative n of a positive p has low * p <= unit * n <= high * p, `share` being (low, high, unit).
    """
    spark = embeddings.sparkSession
    rows = valid_rows(embeddings)
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(F.abs(v * scale) + 1.0, 2.0))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("largest"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        return spark.createDataFrame([], RESULT)
    residues = Residues(int(min(top["largest"], 1e30) * (1 + 1e-9)) + 1)
    rows = rows.where(F.size("x") == top["size"])
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v"))
    asked = cut(asked.select(F.col("vec_id").alias("anchor_id"), "v.label", "v.x"))
    parts = _blocks(top["n"], top["size"]), max(1, -(-asked.count() // min(MOST_BLOCK, max(1, CELLS // max(top["size"], 1)))))
    low, high, unit = share

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
            anchors, own = right.column("anchor_id").to_numpy(), right.column("label").to_numpy()
            same = {v: np.flatnonzero(labels == v) for v in np.unique(own).tolist()}
            for k, scores in _scored(residues, scale, left, right):
                at = same[int(own[k])]
                at = at[ids[at] != anchors[k]]
                at = at[best(scores[at], ids[at], positives)]
                found += [(int(anchors[k]), int(ids[i]), int(scores[i])) for i in at]
        return _table(found, "anchor_id long, vec_id long, score long")

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
            anchors, own = right.column("anchor_id").to_numpy(), right.column("label").to_numpy()
            chosen = right.column("chosen").to_pylist()
            other = {v: np.flatnonzero(labels != v) for v in np.unique(own).tolist()}
            for k, scores in _scored(residues, scale, left, right):
                at = other[int(own[k])]
                mine = scores[at]
                for one in chosen[k]:
                    p = one["score"]
                    inside = at[(mine >= -(-low * p // unit)) & (mine <= high * p // unit)]
                    inside = inside[best(scores[inside], ids[inside], negatives)]
                    found += [(int(anchors[k]), one["slot"], one["vec_id"], p, int(ids[i]), int(scores[i])) for i in inside]
        return _table(found, "anchor_id long, slot long, positive_id long, positive_score long, negative_id long, negative_score long")

    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    firsts = _meet(rows, asked, parts, near, "anchor_id long, vec_id long, score long").withColumn("slot", place)
    firsts = firsts.where(F.col("slot") <= positives).groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "vec_id", "score")).alias("chosen"))
    windows = cut(asked.join(firsts, "anchor_id"))
    schema = "anchor_id long, slot long, positive_id long, positive_score long, negative_id long, negative_score long"
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    ranked = _meet(rows, windows, parts, far, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v AS a, v AS b WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s
  WHERE label = own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def relabelled(embeddings: DataFrame) -> DataFrame:
    """Labels as the query wants them: of ids divisible by 7 the next of ten."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", shifted.alias("label"), "embedding")
