"""Best-fit packing of token pieces by exact complements.

Lengths are integers up to the capacity, so the whole plan depends only on how many pieces there are of each length: a
table of at most ``capacity`` rows, whatever the number of documents. For each length, longest first, the plan looks
for one, two or three other lengths that exactly fill the rest and uses that combination as often as the counts allow;
what no exact combination takes is placed by best fit, decreasing. Both work on counts, never on single pieces.

A piece then finds its place from its rank among the pieces of its length. Ranks are made in two levels (counts of
(length, bucket), then a window in each), so a length that holds a third of all rows is split over many tasks.

Defined cases: a NULL text counts as empty (one piece with the end id alone); a NULL doc_id is kept; repeated rows are
packed as often as they occur; an empty table gives an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import tokens
from barloom.llm.common import cut

CAPACITY = 4096
END_ID = 1
BUCKET_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, entries: int = tokens.CACHE_ENTRIES) -> DataFrame:
    """Cut every document's ids into pieces of at most `capacity`; only the last may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                raws = tokens.encode_all(path, part.column(1).to_pylist(), end_id, entries)
                for doc_id, raw in zip(part.column(0).to_pylist(), raws, strict=True):
                    for k, p in enumerate(range(0, len(raw), width)):
                        x = raw[p : p + width]
                        rows.append((doc_id, k, p // 4, len(x) // 4, zlib.crc32(x)))
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Complements:
    """Lengths still available, and the combinations of one, two or three of them with a given sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.there = self.left > 0

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
            self.there[x] = self.left[x] > 0

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often all of them can be taken together."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        return min(int(self.left[x]) // k for x, k in need.items())

    def pair(self, total: int, largest: int) -> tuple[int, int] | None:
        """Two available lengths with that sum, the longer one as long as possible and at most `largest`."""
        high = min(largest, total - 1)
        low = (total + 1) // 2
        if high < low:
            return None
        found = self.there[low : high + 1] & self.there[total - high : total - low + 1][::-1]
        if 2 * low == total and self.left[low] < 2:
            found[0] = False
        at = np.flatnonzero(found)
        return (low + int(at[-1]), total - low - int(at[-1])) if len(at) else None

    def combination(self, total: int, largest: int) -> tuple[int, ...] | None:
        """The exact complement with the fewest pieces; every piece is at most `largest`."""
        if total <= largest and self.there[total]:
            return (total,)
        if two := self.pair(total, largest):
            return two
        for a in np.flatnonzero(self.there[: min(largest, total - 2) + 1])[::-1].tolist():
            if 3 * a < total:
                break
            self.left[a] -= 1
            self.there[a] = self.left[a] > 0
            two = self.pair(total - a, a)
            self.left[a] += 1
            self.there[a] = True
            if two:
                return (a, *two)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences follow each; uses every piece exactly once."""
    have = Complements(counts, capacity)
    patterns: list[tuple[tuple[int, ...], int]] = []
    if have.left[capacity]:
        patterns.append(((capacity,), int(have.left[capacity])))
        have.take((capacity,), int(have.left[capacity]))
    residual: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        while have.left[length]:
            have.take((length,), 1)  # this one looks for its complement among the others
            others = have.combination(capacity - length, length)
            have.take((length,), -1)
            if not others:
                residual.append((length, int(have.left[length])))
                have.take((length,), int(have.left[length]))
                break
            whole = (length, *others)
            n = have.times(whole)
            patterns.append((whole, n))
            have.take(whole, n)
    return patterns + best_fit(residual, capacity)


def best_fit(residual: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on counts: equal open sequences are handled together."""
    open_by_gap: dict[int, dict[tuple[int, ...], int]] = {}
    gaps: list[int] = []

    def add(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if gap not in open_by_gap:
            open_by_gap[gap] = {}
            bisect.insort(gaps, gap)
        open_by_gap[gap][pattern] = open_by_gap[gap].get(pattern, 0) + n

    for length, n in residual:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                for k, m in ((each, n // each), (n % each, 1)):
                    if k and m:
                        add(capacity - k * length, (length,) * k, m)
                break
            gap = gaps[at]
            pattern, m = next(iter(open_by_gap[gap].items()))
            each = gap // length
            if n >= each * m:
                k, used = each, m
            elif n >= each:
                k, used = each, n // each
            else:
                k, used = n, 1
            if used == m:
                del open_by_gap[gap][pattern]
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                    gaps.pop(at)
            else:
                open_by_gap[gap][pattern] = m - used
            add(gap - k * length, pattern + (length,) * k, used)
            n -= k * used
    return [(p, m) for by in open_by_gap.values() for p, m in by.items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> first rank, first sequence and offset of each run of pieces of that length."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with `rank` (from 0) among those of their length, and the number of each length."""
    n = pieces.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    tagged = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = tagged.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = tagged.withColumn("row", F.row_number().over(within)).join(starts, ["length", "bucket"])
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return rows.withColumn("rank", F.col("before") + F.col("row") - 1), counts


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    rows, counts = ranked(pieces)
    table = places(plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, off = table[int(x)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], off[k]
            cols = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kept = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return kept.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, entries: int = tokens.CACHE_ENTRIES) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return pack(cut(token_pieces(docs, path or tokens.vocabulary_path(), capacity, entries=entries)), capacity)
