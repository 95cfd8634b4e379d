"""Repeated passages, found by anchors at the places of a difference cover and removed word by word.

A window is `window` consecutive words. Of every text, shorter runs of words (anchors) are hashed, only where the place modulo
`period` belongs to a difference cover: any two places have a shift below the period that takes both into the cover, so
two equal windows share an aligned anchor. The steps:

1. anchors of each text, as (anchor, document) rows; the rows of one anchor meet in a sorted partition and an anchor with two
   rows is shared. A task first puts its own rows together: of an anchor that several of its documents hold, one row
   goes to the anchor's partition and the others, known to be shared, are dealt by document, so no anchor is hot;
2. shared anchors go back to their documents and are extended: each window around one becomes a 96-bit key, and an aggregate
   that combines in the tasks finds the smallest document of each key (the owner);
3. owned keys go back to their owners. A window around a shared anchor that its document does not own starts
   in a smaller one; a window that repeats inside a document is found there. The words of both are removed.

The texts are dealt by document once; all three steps read that exchange. Windows count as equal when their words' 64-bit
hashes are equal as sequences, compared by 96-bit keys.

Defined cases: a NULL or empty text has no words; texts shorter than a window lose nothing; rows that share a doc_id are judged
each for itself against smaller documents and never remove words of one another; a NULL doc_id (and the smallest long) is the smallest id;
identical rows give identical results; an empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, PERIOD = 20, 13
#: Perfect difference sets by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
PIECE = 1 << 20  # bytes of a text that are hashed at a time
SLICE = 2_000  # documents whose anchors a task puts together before they are dealt
NO_ID = -(1 << 63)
SPREAD, TURN, OTHER = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA5A3564E9B1C7F35))
LOW = np.uint64(3)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
AT_SPACE = re.compile(rb"[\x20\x09-\x0D]")
KNOWN, SINGLE, SEVERAL = 0, 1, 2


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def split(text: bytes | None) -> list[bytes]:
    """The words between the six ASCII white-space characters, which is what splitting bytes means."""
    return text.split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = x * SPREAD
    return x ^ (x >> np.uint64(29))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and the powers of an odd number and of its inverse modulo 2^64."""
    values = np.random.default_rng(29).integers(0, 1 << 64, 256, np.uint64)
    inverse = np.uint64(pow(int(TURN), -1, 1 << 64))
    powers = np.full(PIECE, TURN, np.uint64), np.full(PIECE, inverse, np.uint64)
    for p in powers:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return values, *powers


def long_hash(word: bytes) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(word)], np.uint64)


def _piece_hashes(text: bytes) -> np.ndarray:
    letters = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[letters], [True]])))
    starts, stops = edges[::2], edges[1::2]
    if len(letters) > PIECE:  # a word of more than half a piece is in the way: word by word
        return np.concatenate([_piece_hashes(text[i:j]) if j - i <= PIECE // 2 else long_hash(text[i:j]) for i, j in zip(starts, stops, strict=True)])
    values, powers, inverses = _hash_tables
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(values[letters] * powers[: len(letters)], out=sums[1:])
    own = (sums[stops] - sums[starts]) * inverses[starts]
    own = mix(mix(own + (stops - starts).astype(np.uint64) * OTHER))
    for k in np.flatnonzero(stops - starts > PIECE // 2):
        own[k] = long_hash(text[starts[k] : stops[k]])[0]
    return own


def hashes(text: bytes | None) -> np.ndarray:
    """64-bit hash of every word: a sum over its bytes, taken from running sums over the text."""
    found, at = [], 0
    while text and at < len(text):
        stop = len(text)
        if stop - at > PIECE:
            last = AT_SPACE.search(text, at + PIECE // 2)
            stop = last.start() if last else stop
        found.append(_piece_hashes(text[at:stop] if at or stop < len(text) else text))
        at = stop
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


_hash_tables = _tables()


def rolling(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` values, put together from runs of one, two, four ... values."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, at, out = h, 1, 0, None
    while True:
        if length & size:
            part = level[at : at + n]
            out = mix(part) if out is None else mix(out * TURN + part)
            at += size
        if 2 * size > length:
            return out
        level = mix(level[:-size] * TURN + level[size:])
        size *= 2


class Cover:
    """Window length, period and cover, with the anchor length that they leave."""

    def __init__(self, window: int = WINDOW, period: int = PERIOD):
        if period not in COVERS or period > window:
            raise ValueError(f"period must be one of {sorted(COVERS)} and at most the window of {window}")
        self.window, self.period, self.anchor = window, period, window - period + 1
        self.inside = np.isin(np.arange(period), COVERS[period])

    def anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and 61-bit hashes of the anchors; texts shorter than a window have none."""
        if len(h) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(h) - self.anchor + 1
        at = np.flatnonzero(np.resize(self.inside, n))
        return at, (rolling(h, self.anchor)[at] >> LOW).view(np.int64)

    def around(self, h: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the shared anchors at a place of the cover."""
        at, found = self.anchors(h)
        at = at[np.isin(found, shared)]
        n = len(h) - self.window + 1
        steps = np.zeros(max(n, 0) + 1, np.int64)
        np.add.at(steps, np.minimum(np.maximum(at - self.period + 1, 0), n), 1)
        np.add.at(steps, np.minimum(at + 1, n), -1)
        return np.flatnonzero(np.cumsum(steps[:-1]) > 0)

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit and the 32-bit half of every window's key."""
        low = rolling(h, self.window).view(np.int64)
        high = (rolling(mix(h ^ OTHER), self.window) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return low, high

    def removed(self, h: np.ndarray, shared: np.ndarray, owned: np.ndarray) -> np.ndarray:
        """Which words lie in a window that starts earlier as well."""
        n = len(h) - self.window + 1
        if n <= 0:
            return np.zeros(len(h), bool)
        low = rolling(h, self.window).view(np.int64)
        starts, sorted_low = np.zeros(0, np.int64), np.sort(low)
        if (sorted_low[1:] == sorted_low[:-1]).any():
            high = self.keys(h)[1]
            order = np.lexsort((np.arange(n), high, low))
            again = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
            starts = order[1:][again]
        if len(shared):
            near = self.around(h, shared)
            starts = np.concatenate([starts, near[~np.isin(low[near], owned)]])
        steps = np.zeros(len(h) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + self.window, -1)
        return np.cumsum(steps[:-1]) > 0


def put_together(anchors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one task: the anchor with its kind in the two lowest bits, and the document."""
    order = np.argsort(anchors, kind="stable")
    anchors, ids = anchors[order], ids[order]
    begins = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    followed = np.concatenate([~begins[1:], [False]])
    kind = np.where(begins, np.where(followed, SEVERAL, SINGLE), KNOWN)
    return (anchors << 2) | kind, ids


def _anchor_rows(texts: DataFrame, cover: Cover) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, found = [], []
                for one, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                    mine = np.unique(cover.anchors(hashes(text))[1])
                    found.append(mine)
                    ids.append(np.full(len(mine), one, np.int64))
                rows = np.concatenate(found) if found else np.zeros(0, np.int64)
                if len(rows):
                    x, y = put_together(rows, np.concatenate(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "id"])

    return texts.mapInArrow(run, "x long, id long")


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """id, anchor for every anchor that two documents hold. Equal anchors lie side by side, so a row needs its two neighbours only."""
    known = F.col("x").bitwiseAND(F.lit(3)) == KNOWN
    place = F.when(known, F.xxhash64("x", "id")).otherwise(F.shiftright("x", 2))
    dealt = rows.repartition(place).sortWithinPartitions("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, 2), np.int64)  # the row before this batch, whose next neighbour is still to come
        before = False  # whether that row equals the one before it
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = np.concatenate([last, np.column_stack([batch.column(i).to_numpy() for i in range(2)])])
            anchor, kind = rows[:, 0] >> 2, rows[:, 0] & 3
            same = anchor[1:] == anchor[:-1]
            shared = (kind != SINGLE) | np.concatenate([[before and len(last) > 0], same]) | np.concatenate([same, [False]])
            done = shared[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(rows[:-1, 1][done]), pa.array(anchor[:-1][done])], names=["id", "anchor"])
            last, before = rows[-1:], bool(same[-1]) if len(same) else False
        if len(last) and (before or (last[0, 0] & 3) != SINGLE):
            yield pa.RecordBatch.from_arrays([pa.array(last[:, 1]), pa.array(last[:, 0] >> 2)], names=["id", "anchor"])

    return dealt.mapInArrow(run, "id long, anchor long")


def _values(column: pa.Array, at: int) -> np.ndarray:
    one = column[at]
    return one.values.to_numpy(zero_copy_only=False) if one.is_valid else np.zeros(0, np.int64)


def _window_keys(texts: DataFrame, cover: Cover) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (one, text) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)):
                h = hashes(text)
                near = cover.around(h, _values(batch.column(2), i))
                low, high = cover.keys(h)
                low, first = np.unique(low[near], return_index=True)
                out.append((low, high[near][first], np.full(len(low), one, np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["low", "high", "id"])

    return texts.mapInArrow(run, "low long, high int, id long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """doc_id, n_words, removed (array of word ranges [start, stop)) and kept_text (kept words joined by one space)."""
    cover = Cover(window, period)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    texts = docs.select(key.alias("id"), "text").repartition("id")
    shared = _shared_anchors(_anchor_rows(texts, cover)).groupBy("id").agg(F.collect_list("anchor").alias("shared"))
    keys = _window_keys(texts.join(shared, "id").select("id", "text", "shared"), cover)
    owners = keys.groupBy("low", "high").agg(F.min("id").alias("id"))
    owned = owners.groupBy("id").agg(F.collect_list("low").alias("owned"))
    rows = texts.join(shared, "id", "left").join(owned, "id", "left").select("id", "text", "shared", "owned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, sizes, spans, kept = part.column(0).to_pylist(), [], [], []
                for i, text in enumerate(texts_of(part.column(1))):
                    words = split(text)
                    gone = cover.removed(hashes(text), _values(part.column(2), i), _values(part.column(3), i))
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                    ranges = list(zip(edges[::2], edges[1::2], strict=True))
                    left, begin = [], 0
                    for start, stop in ranges:
                        left += words[begin:start]
                        begin = stop
                    sizes.append(len(words))
                    spans.append([{"start": a, "stop": b} for a, b in ranges])
                    kept.append(b" ".join(left + words[begin:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if i == NO_ID else i for i in ids], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(spans, span),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "removed", "kept_text"],
                )

    return rows.mapInArrow(run, "doc_id long, n_words long, removed array<struct<start:int,stop:int>>, kept_text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    return remove_repeats(docs).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
