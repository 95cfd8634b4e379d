"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint; fingerprints within the radius r are linked and the links' components are the
near-duplicate groups. Candidates come from structured bit masks: each bit gets a vector over r + 1 binary coordinates,
and the mask of a nonzero vector v keeps the bits whose vector has an odd inner product with v. The vectors of r differing bits
span at most r dimensions, so some v is orthogonal to all of them and its mask hides every difference: each pair
within the radius collides in at least one of the 2^(r+1) - 1 tables, without exception.

Copies collapse to one row per distinct fingerprint before anything is compared. A bucket above the block size is split
by covering the bits its mask left out, again without losing a pair; three levels leave 8 free bits, thus at most 256
fingerprints. Inside a bucket a task compares fingerprints but hands on a spanning forest, fewer links than members.

Defined cases: a NULL, empty or wordless text has fingerprint zero and is linked like any other; fewer words than a
shingle has make one shingle; a bit set in exactly half the hashes is 0; a NULL doc_id gets a fingerprint, counts last for the smallest id
and comes back; repeated rows come back as often; rows that repeat an id with other texts are one document, so what one of them reaches
the others reach too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ASCII_LOWER, WORD, cut
from barloom.llm.components import components

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
BLOCK = 2_048
LEVELS = 3
CHUNK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the shingles' hashes, repeats included."""
    import xxhash

    words = WORD.findall((text or "").translate(ASCII_LOWER) if text and not text.islower() else text or "")
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: list[int] | None = None) -> list[int]:
    """The masks (as signed longs) of all nonzero vectors, over the given bit places."""
    places = list(range(BITS)) if bits is None else bits
    size = 1 << (radius + 1)
    vector = {b: 1 + i % (size - 1) for i, b in enumerate(places)}
    masks = []
    for v in range(1, size):
        kept = sum(1 << b for b in places if (vector[b] & v).bit_count() % 2)
        masks.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return masks


def _with_masks(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """A row for each mask. From the second level on, masks cover the bits that the row's mask leaves out."""
    if level == 0:
        table = {0: covering_masks(radius)}
    else:
        parents = [0]
        for _ in range(level):
            parents = [m for p in parents for m in _children(p, radius)]
        table = {p: _children(p, radius) for p in set(parents)}
    if level == 0:
        masks: Column = F.array(*[F.lit(m) for m in table[0]])
        return rows.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    spark = rows.sparkSession
    known = spark.createDataFrame([(p, m) for p, ms in table.items() for m in ms], "mask long, next long")
    grown = rows.select("fp", "mask").join(F.broadcast(known), "mask")  # (2^(r+1) - 1)^level rows at most
    return grown.select("fp", F.col("next").alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct()


def _children(mask: int, radius: int) -> list[int]:
    free = [b for b in range(BITS) if not (mask >> b) & 1]
    signed = mask
    return [signed | m for m in covering_masks(radius, free)]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join the same fingerprints as all such links do: a breadth-first forest."""
    values = fps.view(np.uint64)
    waiting = np.arange(len(values))
    links: list[tuple[int, int]] = []
    while len(waiting) > 1:
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(values[waiting] ^ values[at]) <= radius
            hit = waiting[near]
            links += [(int(fps[at]), int(fps[i])) for i in hit]
            front += hit.tolist()
            waiting = waiting[~near]
    return links


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Forest links of every (mask, key) bucket.

    An aggregate makes a bucket one row. A repartition would not hold it together: after a join on the same keys the planner drops it
    as already met, and the join's own exchange may then be read in pieces once that join turns into a broadcast.
    """
    whole = buckets.groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(0).value_lengths().to_numpy())
            if links := _links(batch.column(0).flatten().to_numpy(), ends[:-1], radius):
                yield _as_batch(links)

    return whole.mapInArrow(run, "a long, b long")


def _links(fps: np.ndarray, cuts: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of consecutive buckets that begin at the cuts; buckets of two are compared all at once."""
    edges = np.concatenate([[0], cuts, [len(fps)]]).astype(np.int64)
    sizes = np.diff(edges)
    first = edges[:-1][sizes == 2]
    a, b = fps[first], fps[first + 1]
    close = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
    links = list(zip(a[close].tolist(), b[close].tolist(), strict=True))
    for k in np.flatnonzero(sizes > 2):
        links += forest(np.ascontiguousarray(fps[edges[k] : edges[k + 1]]), radius)
    return links


def _as_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect exactly what links within the radius connect."""
    rows, out = distinct.select("fp"), None
    for level in range(LEVELS):
        tagged = _with_masks(rows, radius, level)
        sizes = tagged.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
        if level == LEVELS - 1:
            small = tagged.join(sizes, ["mask", "key"])
        else:
            sizes = cut(sizes)
            small = tagged.join(sizes.where(F.col("size") <= block), ["mask", "key"])
        links = _bucket_links(small, radius)
        out = links if out is None else out.unionByName(links)
        if level == LEVELS - 1 or sizes.where(F.col("size") > block).isEmpty():
            break
        rows = cut(tagged.join(sizes.where(F.col("size") > block), ["mask", "key"]).select("fp", "mask"))
    return out.distinct()


def same_id_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) from the smallest fingerprint of a doc_id to its others; most ids have none."""
    ids = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("most"))
    return prints.join(ids.where("b < most"), "doc_id").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def group(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds component_id, the smallest doc_id reachable over links and rows of one id, to (doc_id, fp)."""
    prints = cut(prints)
    owners = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")))
    nodes = components(near_links(owners, radius).unionByName(same_id_links(prints)))
    found = nodes.join(owners, nodes["node"] == owners["fp"]).select("fp", "root", "owner")
    least = found.groupBy("root").agg(F.min("owner").alias("least"))
    joined = found.join(least, "root").select("fp", "least")
    labels = owners.join(joined, "fp", "left").select("fp", F.coalesce("least", "owner").alias("component_id"))
    labels = cut(labels)  # so that the last join has two plain exchanges, which can split a hot fingerprint
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id."""
    rows = group(fingerprints(docs, shingle), radius)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group, with all its columns: the one with the smallest doc_id.

    Rows that repeat an id are one document and stay together; a NULL id stays only where its group has no other.
    """
    rows = group(fingerprints(docs, shingle), radius)
    gone = rows.where(F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull()))
    gone = gone.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]), "left_anti")
