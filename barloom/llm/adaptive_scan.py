"""Approximate nearest neighbours by inner product: probed lists, scanned adaptively by blocks of rotated dimensions.

A vector x becomes (x, sqrt(M^2 - |x|^2)), M being the largest norm, and a query q becomes (q, 0); the nearest point in
Euclidean distance is then the one with the largest inner product. Points are dealt to lists by their nearest centroid
and each query goes to its nearest lists. In a list, points and queries are turned by a random rotation and kept as
blocks of columns. A candidate is given up after the block in which its partial distance exceeds the best distances so far, so
no point of a probed list is lost. What survives all blocks is scored in double precision on the original vectors. The queries of a list are compared together, and each begins with the
distance of its k-th best among the fitting sample in its own lists, behind which nothing can be among its k nearest.

Centroids, rotation and the share of lists to probe are fitted on at most SAMPLE vectors (those with the smallest hash of their id);
every vector is indexed. The share probed is the smallest that finds TARGET of the true neighbours in the sample.
A long list is cut into blocks of points and its queries into chunks, so a task holds a bounded part of both.

Defined cases: vectors that are NULL, zero or hold NULL or non-finite components take no part, nor do those of another length than the
most frequent one of the candidates (the longer at a tie); rows with a NULL id are left out; a query's own id is never its neighbour, so repeated ids do not find each other; equal
scores go to the smaller id; with fewer than k candidates all are returned; an empty table gives an empty result;
columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import bounded_sample, cut

SAMPLE = 12_000
TARGET = 0.98
TRIALS = 150
ROUNDS = 8
COLUMNS = 16
BLOCK, CHUNK = 4_096, 2_048
GROUP, STEP, PAIRS = 256, 1_024, 65_536  # queries and points compared at a time, pairs scored at a time
MAX_LISTS = 1_024


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x (array<double>) of the vectors that may take part, of any length."""
    x = F.col("embedding").cast("array<double>")
    rows = rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("x").isNotNull() & fine & F.exists("x", lambda v: v != 0))


def usual_length(rows: DataFrame) -> int:
    """The most frequent length (the longer at a tie), 0 without rows."""
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size"))
    first = sizes.first()
    return first["size"] if first else 0


class Index:
    """Centroids, rotation, largest norm and number of lists to probe; small, and sent to every task."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, largest: float, total: int, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.largest = largest
        self.ids, self.sample = ids, sample
        points = self.points(sample)
        size = points.shape[1]
        self.turn = np.linalg.qr(rng.normal(size=(size, size)))[0].astype(np.float32)
        lists = int(max(1, min(total**0.5, MAX_LISTS, len(sample) / 8)))
        self.centroids = self._centroids(points, lists, rng)
        self.places = self.assign(sample)
        self.probes = self._calibrate(sample, points, k, rng)

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.largest**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None]

    def _centroids(self, points: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
        centers = points[np.sort(rng.choice(len(points), lists, replace=False))].copy()
        for _ in range(ROUNDS):
            at = np.argmin(self.distances(points, centers), axis=1)
            n = np.bincount(at, minlength=lists)
            sums = np.zeros_like(centers)
            np.add.at(sums, at, points)
            centers[n > 0] = sums[n > 0] / n[n > 0, None]
        return centers

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Lists from the nearest on, for each query."""
        flat = np.column_stack([queries, np.zeros(len(queries))])
        return np.argsort(self.distances(flat, self.centroids), axis=1, kind="stable")

    def reach(self, query_ids: np.ndarray, queries: np.ndarray, lists: list[np.ndarray], k: int) -> np.ndarray:
        """A squared distance within which each query has k points or more in its lists: that of the k-th best of the sample there."""
        out = np.full(len(queries), np.inf)
        for at in range(0, len(queries) if len(self.sample) > k else 0, GROUP):
            q = queries[at : at + GROUP]
            probed = np.zeros((len(q), len(self.centroids)), bool)
            for row, chosen in zip(probed, lists[at : at + GROUP], strict=True):
                row[chosen] = True
            scores = q @ self.sample.T
            scores[~probed[:, self.places] | (query_ids[at : at + GROUP, None] == self.ids[None])] = -np.inf
            best = np.partition(scores, -k, axis=1)[:, -k]
            out[at : at + GROUP] = self.largest**2 + (q * q).sum(axis=1) - 2 * best
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self.distances(self.points(x), self.centroids), axis=1)

    def _calibrate(self, sample: np.ndarray, points: np.ndarray, k: int, rng: np.random.Generator) -> int:
        tried = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
        scores = sample[tried] @ sample.T
        scores[np.arange(len(tried)), tried] = -np.inf
        best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
        if not best.size:
            return len(self.centroids)
        place = np.argsort(self.order(sample[tried]), axis=1)
        depth = np.take_along_axis(place, self.places[best], axis=1)
        return int(np.quantile(depth, TARGET, method="higher")) + 1


def scan(index: Index, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query_id, vec_id, score: at least the k best for each query among the given points, if they are within the query's reach."""
    scale = index.largest or 1.0  # float32 takes vectors of any length so
    turned = (index.points(x) / scale @ index.turn).astype(np.float32)
    asked = (np.column_stack([queries, np.zeros(len(queries))]) / scale @ index.turn).astype(np.float32)
    slack = 1e-5 * (1 + (asked * asked).sum(axis=1))
    limit = reach / scale**2 + slack
    groups = [slice(q, q + GROUP) for q in range(0, len(queries), GROUP)]
    parts = [_scan(turned, asked[g], ids, query_ids[g], limit[g], slack[g], k) for g in groups]
    at = np.concatenate([a + GROUP * i for i, (a, _) in enumerate(parts)])
    of = np.concatenate([b for _, b in parts])
    chunks = [slice(i, i + PAIRS) for i in range(0, max(1, len(of)), PAIRS)]
    exact = np.concatenate([np.einsum("ij,ij->i", x[of[c]], queries[at[c]]) for c in chunks])
    order = np.lexsort((ids[of], -exact, at))
    at, of, exact = at[order], of[order], exact[order]
    place = np.arange(len(at)) - np.searchsorted(at, at, "left")
    best = place < k
    return query_ids[at[best]], ids[of[best]], exact[best]


def _scan(
    turned: np.ndarray, asked: np.ndarray, ids: np.ndarray, own: np.ndarray, limit: np.ndarray, slack: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, point) of what survives all blocks for a group of queries, which share the matrix products."""
    size, bound = turned.shape[1], limit.astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    dist = np.full((len(asked), 0), np.inf, np.float32)
    for first in range(0, len(turned), STEP):
        points = turned[first : first + STEP]
        partial = np.zeros((len(asked), len(points)), np.float32)
        pairs: tuple[np.ndarray, np.ndarray] | None = None  # once few are left
        partial[own[:, None] == ids[None, first : first + STEP]] = np.inf
        for a in range(0, size, COLUMNS):
            p, q = points[:, a : a + COLUMNS], asked[:, a : a + COLUMNS]
            if pairs is None:
                partial += (q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * (q @ p.T)
                partial[partial > bound[:, None]] = np.inf
                stay = partial != np.inf
                if 8 * np.count_nonzero(stay) < stay.size:
                    pairs = np.nonzero(stay)
                    rest = partial[pairs]
            else:
                i, j = pairs
                rest = rest + ((q[i] - p[j]) ** 2).sum(axis=1)
                stay = ~(rest > bound[i])
                pairs, rest = (i[stay], j[stay]), rest[stay]
        if pairs is None:
            pairs = np.nonzero(partial != np.inf)
            rest = partial[pairs]
        found.append((pairs[0], pairs[1] + first, rest))
        if first + STEP < len(turned):  # the k nearest so far bound what follows
            now = np.full(partial.shape, np.inf, np.float32)
            now[pairs] = rest
            dist = np.concatenate([dist, now], axis=1)
            if dist.shape[1] >= k:
                dist = np.partition(dist, k - 1, axis=1)[:, :k]
                bound = np.minimum(bound, dist[:, k - 1] + slack.astype(np.float32))
    at, of, rest = (np.concatenate(c) for c in zip(*found, strict=True))
    near = ~(rest > bound[at])
    return at[near], of[near]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _parts(counts: dict[int, int], size: int) -> Column:
    """How many parts each list is cut into; lists beyond one part only."""
    long = {k: -(-n // size) for k, n in counts.items() if n > size}
    if not long:
        return F.lit(1)
    table = F.create_map(*[F.lit(v) for kv in long.items() for v in kv])
    return F.coalesce(F.try_element_at(table, F.col("list")), F.lit(1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for `queries` (vec_id, embedding) among `vectors` (vec_id, embedding)."""
    rows, asked = valid_vectors(vectors), valid_vectors(queries)
    same = F.size("x") == usual_length(rows)  # the candidates' length holds for the queries too
    rows, asked = rows.where(same), asked.where(same)
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    total = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("largest")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    sample = bounded_sample(rows, "vec_id", SAMPLE).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], empty)
    index = Index(np.array([r["vec_id"] for r in sample]), np.array([r["x"] for r in sample]), float(total["largest"]), total["n"], k)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = index.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["vec_id", "x", "list"])

    dealt = cut(rows.mapInArrow(deal, "vec_id long, x array<double>, list int"))
    sizes = {r["list"]: r["n"] for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            order = index.order(x)
            enough = (np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1  # k others and the query itself
            lists = [o[: max(index.probes, e)].astype(np.int32) for o, e in zip(order, enough, strict=True)]
            reach = index.reach(batch.column(0).to_numpy(), x, lists, k)
            columns = [*batch.columns, pa.array(reach), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "reach", "lists"])

    routed = asked.mapInArrow(route, "vec_id long, x array<double>, reach double, lists array<int>")
    routed = cut(routed).select("vec_id", "x", "reach", F.explode("lists").alias("list"))
    wanted = {r["list"]: r["n"] for r in routed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks, chunks = _parts(sizes, BLOCK), _parts(wanted, CHUNK)
    key = F.xxhash64("vec_id", "x")
    points = dealt.withColumn("block", F.pmod(key, blocks).cast("int"))
    points = points.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    probing = routed.withColumn("chunk", F.pmod(key, chunks).cast("int"))
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            ids, query_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            found = scan(index, ids, _matrix(left.column("x")), query_ids, _matrix(right.column("x")), right.column("reach").to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ("list", "block", "chunk")
    near = points.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInArrow(join, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`."""
    return search(embeddings, embeddings.where(F.col("vec_id") % every == 0), k)
