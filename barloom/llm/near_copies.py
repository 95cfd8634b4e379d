"""Near copies by five-word shingles: groups of documents whose shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come from two kinds of links between distinct shingle sets, and an exact check decides.

* SimHash by covering masks (`simhash.near_links`), on fingerprints of five-word shingles with a radius of 3: 15 tables, no
  pair within the radius is lost. At a similarity of 0.8 about 10 of 64 bits differ, and tables double with each
  bit of the radius, so this finds the closer copies only.
* Every set gets 32 bucket keys, each from four minima of random orders of its shingles, and 128 single bits of
  those minima. Sets that meet in a bucket and differ in few bits are linked; this is set so wide that a pair at 0.8 exactly is
  missed with a probability of 7e-8 (more alike pairs are missed less).

The components of all links then hold every group as a whole, and inside each the sets themselves are compared: the groups are
the components of the pairs with an exact similarity of at least 0.8, found breadth first over an index of the shingles.

Copies collapse to one row per distinct set before anything is compared. Shingles are compared by 64-bit hashes. A task holds the
sets of one candidate component at a time (8 bytes a shingle, about three times that while compared).

Defined cases: words are lower-cased by Unicode and parted by ASCII spaces; fewer words than a shingle has make one shingle; NULL, empty
and wordless texts are copies of each other; a NULL doc_id counts last for the smallest id; repeated rows stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.common import WORD, cut
from barloom.llm.components import components

SHINGLE = 5
BANDS = 32
ROWS = 4
#: Bits of the SimHash fingerprints that may differ.
RADIUS = 3
#: Bits that may differ among 128. At a similarity of 0.8 each differs with probability 0.1.
BITS_APART = 34
SEED = 42
CHUNK = 4_096
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 2**64, BANDS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of the text's distinct shingles, sorted."""
    import xxhash

    words = WORD.findall((text or "").lower())
    if len(words) < SHINGLE:
        shingles = [" ".join(words)] if words else []
    else:
        shingles = map(" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def identity(found: np.ndarray) -> int:
    """One signed number for a whole shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of a set that isn't empty, and its 128 bits as two numbers."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[at : at + CHUNK, None] ^ _FLIP) * _ODD).min(axis=0))
    keys = _BAND.copy()
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * _MIX
        keys ^= keys >> np.uint64(29)
    bits = np.packbits((least * _MIX) >> np.uint64(63) == 1)
    return keys.view(np.int64), bits.view(np.int64)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of id and text), fp (the set's number), print (its SimHash), two numbers of bits, and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(2):
                found = shingle_set(text.as_py())
                keys, bits = sketch(found) if len(found) else (np.zeros(0, np.int64), np.zeros(2, np.int64))
                rows.append((identity(found), np.uint64(simhash.majority(found)).astype(np.int64), bits[0], bits[1], keys))
            numbers = [pa.array(np.array([r[k] for r in rows], np.int64)) for k in range(4)]
            ends = np.cumsum([0] + [len(r[4]) for r in rows]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(r[4] for r in rows)])))
            names = ["doc_id", "tag", "fp", "print", "one", "two", "keys"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, keys], names=names)

    return _tagged(docs).mapInArrow(run, "doc_id long, tag long, fp long, print long, one long, two long, keys array<long>")


def _tagged(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("tag"), "text")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The rows of each key (first column) of sorted number columns, without keys that have a single row."""
    held: np.ndarray | None = None
    for batch in batches:
        new = np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns)])
        rows = new if held is None else np.concatenate([held, new], axis=1)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1]).astype(int)
        for k in np.flatnonzero(np.diff(edges) > 1):
            yield rows[:, edges[k] : edges[k + 1]]
        held = rows[:, edges[-1] :]
    if held is not None and held.shape[1] > 1:
        yield held


def forest(fps: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Links of a bucket that join the same sets as all pairs with few different bits do: a breadth-first forest."""
    waiting = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    while len(waiting) > 1:
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(bits[:, waiting] ^ bits[:, [at]]).sum(axis=0, dtype=np.int64) <= BITS_APART
            hit = waiting[near]
            links += [(int(fps[at]), int(fps[i])) for i in hit]
            front += hit.tolist()
            waiting = waiting[~near]
    return links


def simhash_links(owners: DataFrame) -> DataFrame:
    """Links (a, b) that join the numbers of sets whose SimHash differs in at most RADIUS bits; sets of one SimHash meet at the smallest."""
    sets = owners.where(F.size("keys") > 0).select("fp", "print")
    heads = cut(sets.groupBy("print").agg(F.min("fp").alias("head"), F.count("*").alias("n")))
    near = simhash.near_links(heads.select(F.col("print").alias("fp")), RADIUS)
    first, second = (heads.select(F.col("print").alias(c), F.col("head").alias(f"{c}_head")) for c in ("a", "b"))
    far = near.join(first, "a").join(second, "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    same = sets.join(heads.where("n > 1"), "print").where("fp != head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    return far.unionByName(same)


def bucket_links(owners: DataFrame) -> DataFrame:
    """Links (a, b) between the numbers of sets that meet in a bucket and differ in few bits."""
    n = int(owners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = owners.select(F.explode("keys").alias("key"), "fp", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for _, fps, *bits in _runs(b for b in batches if b.num_rows):
            links += forest(fps, np.stack(bits).view(np.uint64))
            if len(links) > CHUNK:
                yield _as_batch(links, ["a", "b"])
                links = []
        if links:
            yield _as_batch(links, ["a", "b"])

    dealt = buckets.repartition(n, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _as_batch(rows: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)


def exact_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of the first one of its group: components of the pairs with a similarity of 0.8 or more."""
    sizes = np.array([len(x) for x in sets])
    label = np.arange(len(sets))
    waiting = np.ones(len(sets), bool)
    built = 0
    for start in range(len(sets)):
        if not waiting[start]:
            continue
        front, waiting[start] = [start], False
        while front and (left := int(waiting.sum())):
            if built == 0 or 2 * left < built:  # the index forgets sets that are done
                built, there = left, np.flatnonzero(waiting)
                flat = np.concatenate([sets[i] for i in there])
                order = np.argsort(flat, kind="stable")
                flat, whose = flat[order], np.repeat(there, sizes[there])[order]
            at = front.pop()
            low, high = np.searchsorted(flat, sets[at], "left"), np.searchsorted(flat, sets[at], "right")
            count = high - low
            places = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(whose[places], minlength=len(sets))
            hit = np.flatnonzero(waiting & (9 * common >= 4 * (sizes[at] + sizes)))  # common / union >= 0.8
            label[hit], waiting[hit] = start, False
            front += hit.tolist()
    return label


def _settled(sets: DataFrame) -> DataFrame:
    """fp and label, the number of one set of its exact group, from (root, fp, found) of whole candidate components."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def settle(held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        fps = list(held)
        return [(fps[i], fps[k]) for i, k in enumerate(exact_groups(list(held.values()))) if i != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = None, {}
        for batch in batches:
            rows: list[tuple[int, int]] = []
            for r, fp, found in zip(*(batch.column(i) for i in range(3)), strict=True):
                if r.as_py() != root:
                    rows += settle(held)
                    root, held = r.as_py(), {}
                held[fp.as_py()] = np.frombuffer(found.as_py(), np.uint64)
            if rows:
                yield _as_batch(rows, ["fp", "label"])
        if rows := settle(held):
            yield _as_batch(rows, ["fp", "label"])

    return sets.repartition(n, "root").sortWithinPartitions("root", "fp").mapInArrow(run, "fp long, label long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """root, fp and the shingle set of one row of each wanted (tag, fp, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py()) for t in batch.column(2)]
            right = pa.array([identity(x) == fp.as_py() for x, fp in zip(found, batch.column(1), strict=True)], pa.bool_())
            out = [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["root", "fp", "found"]).filter(right)

    texts = _tagged(docs).groupBy("tag").agg(F.first("text").alias("text"))
    return texts.join(wanted, "tag").select("root", "fp", "text").mapInArrow(run, "root long, fp long, found binary")


def group(docs: DataFrame) -> DataFrame:
    """doc_id, tag and component_id, the smallest doc_id of its near copies, for every row."""
    rows = cut(prints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
    owners = cut(rows.groupBy("fp").agg(first, *(F.first(c).alias(c) for c in ("print", "one", "two", "keys"))))
    nodes = components(simhash_links(owners).unionByName(bucket_links(owners)))
    wanted = owners.join(nodes, owners["fp"] == nodes["node"]).select("first.tag", "fp", "root")
    tied = cut(_settled(_sets(docs, wanted)))
    labels = owners.select("fp", F.col("first.doc_id").alias("owner")).join(tied, "fp", "left")
    labels = labels.select("fp", "owner", F.coalesce("label", "fp").alias("label"))
    least = labels.groupBy("label").agg(F.min("owner").alias("component_id"))
    known = cut(labels.join(least, "label").select("fp", "component_id"))
    return rows.select("doc_id", "tag", "fp").join(known, "fp").select("doc_id", "tag", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the smallest doc_id.

    Rows that repeat an id are one document and stay together; a NULL id stays only where its group has no other.
    """
    rows = group(docs)
    gone = rows.where(F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull()))
    tag = F.when(F.col("doc_id").isNull(), F.col("tag"))  # rows without an id are told apart by their text
    gone = gone.select(F.col("doc_id").alias("gone_id"), tag.alias("gone_tag")).distinct()
    own = docs["doc_id"].cast("long")
    own_tag = F.when(own.isNull(), F.xxhash64(own, docs["text"]))
    return docs.join(gone, own.eqNullSafe(gone["gone_id"]) & own_tag.eqNullSafe(gone["gone_tag"]), "left_anti")
