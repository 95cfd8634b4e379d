"""Token ids in seekable zstandard files: an independent frame for each document, a trailing seek table, checksums.

File layout (the public seekable layering of the zstandard format, so any zstandard reader can decode a file):

* one zstandard frame for each document, in ascending doc_id order: its ids as little-endian unsigned 32-bit integers,
  with content size and content checksum;
* a skippable frame with the documents' ids (a byte each that tells whether there is one, then 64-bit integers);
* a skippable frame with the seek table: for every frame above its compressed and decompressed size and the lower
  32 bits of the content's XXH64, then the number of frames, a flag byte and the seekable magic number.

Tasks write files of their own into the shared folder under a temporary name and rename them when complete, so a task
that is run again after a lost executor leaves the same file.

Defined cases: a NULL text counts as empty (its only id is the end id); a NULL doc_id sorts first and comes back as
NULL; repeated rows are written and read as often as they occur; an empty table gives an empty result; columns other
than the two named ones are not read.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import tokens
from barloom.llm.common import shared_dir

#: Fixed values of the format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
END_ID = 1
MANIFEST = "part int, path string, documents long, ids long"


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def compress_documents(docs: DataFrame, bounds: list[int], path: str, end_id: int, level: int) -> DataFrame:
    """doc_id, bucket (its place among the bounds), n_ids, check and the document's compressed frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_pylist()
                raw = list(tokens.encode_all(path, part.column(1).to_pylist(), end_id))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([0 if i is None else bisect_right(bounds, i) for i in ids], pa.int32()),
                        pa.array([len(x) // 4 for x in raw], pa.int64()),
                        pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in raw], pa.int64()),
                        pa.array([press.compress(x) for x in raw], pa.binary()),
                    ],
                    names=["doc_id", "bucket", "n_ids", "check", "frame"],
                )

    schema = "doc_id long, bucket int, n_ids long, check long, frame binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def write_files(frames: DataFrame, folder: str) -> DataFrame:
    """One file for each partition of sorted frames; returns the manifest rows. A job, not lazy work, should call it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        out, part, ids, entries = None, -1, [], []
        held = f"{base}/.{uuid.uuid4().hex}"
        total = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out, part = store.open_output_stream(held), batch.column(1)[0].as_py()
            ids += batch.column(0).to_pylist()
            packed = batch.column(4).to_pylist()
            n = batch.column(2).to_numpy()
            table = np.zeros(len(packed), ENTRY)
            table["packed"] = [len(x) for x in packed]
            table["size"], table["check"] = 4 * n, batch.column(3).to_numpy()
            entries.append(table)
            total += int(n.sum())
            for x in packed:
                out.write(x)
        if out is None:
            return
        known = np.array([i is not None for i in ids], np.uint8)
        index = known.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
        out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries.append(np.array([(len(index) + 8, 0, 0)], ENTRY))
        body = np.concatenate(entries).tobytes() + struct.pack("<IBI", len(ids) + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)
        out.close()
        name = f"part-{part:05d}.zst"
        store.move(held, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "documents": pa.array([len(ids)], pa.int64()), "ids": pa.array([total], pa.int64())})

    return frames.mapInArrow(run, MANIFEST)


def write_store(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, level: int = 3) -> list[tuple]:
    """Encode and write every document; returns the manifest (a row for each file) in ascending doc_id order.

    Files are cut at quantiles of doc_id, sketched from that column alone; only compressed frames are shuffled.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted({int(x) for x in found})
    frames = compress_documents(docs, bounds, path, end_id, level)
    frames = frames.repartitionById(len(bounds) + 1, F.col("bucket"))
    frames = frames.sortWithinPartitions("doc_id", "n_ids", "check", "frame")
    return sorted(tuple(r) for r in write_files(frames, folder).collect())


class SeekableFile:
    """Reads single documents of one file: the tail first, then only the frames asked for."""

    def __init__(self, uri: str):
        import zstandard

        store, base = open_folder(uri)
        self.file = store.open_input_file(base)
        end = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"no seek table at the end of {uri}")
        table = frames * ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(table, end - 9 - table), ENTRY)
        self.places = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        index = self.file.read_at(int(self.entries["packed"][-1]), int(self.places[-2]))[8:]
        known = np.frombuffer(index[: frames - 1], np.uint8)
        ids = np.frombuffer(index[frames - 1 :], "<i8")
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.sizes = self.entries["size"][:-1].astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def read(self, at: int) -> bytes:
        import xxhash

        frame = self.file.read_at(int(self.entries["packed"][at]), int(self.places[at]))
        raw = self.unpack(frame)
        if len(raw) != self.sizes[at] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries["check"][at]:
            raise ValueError(f"frame {at} does not match its seek table entry")
        return raw


def read_store(spark: SparkSession, manifest: list[tuple], wanted: set[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit bytes).

    A task reads one file, and of it only the frames of the wanted documents (all by default).
    """
    rows, base = [], 0
    for part, uri, _, ids in manifest:
        rows.append((part, uri, base))
        base += ids
    files = spark.createDataFrame(rows, "part int, path string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one = SeekableFile(row["path"])
                starts = row["base"] + np.concatenate([[0], np.cumsum(one.sizes // 4)])
                picked = [i for i, d in enumerate(one.doc_ids) if wanted is None or d in wanted]
                for at in range(0, len(picked), 256):
                    some = picked[at : at + 256]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([one.doc_ids[i] for i in some], pa.int64()),
                            "start": pa.array([int(starts[i]) for i in some], pa.int64()),
                            "ids": pa.array([one.read(i) for i in some], pa.binary()),
                        }
                    )

    if rows:
        files = files.repartition(len(rows))
    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def encode_and_read_back(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest of op8: doc_id, start, n_tokens, ids_crc32, taken from the files."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_store(docs, folder, path or tokens.vocabulary_path())
    back = read_store(spark, manifest)
    return back.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
