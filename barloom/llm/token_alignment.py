"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide link counts.

Tokenizer A is a byte-level vocabulary over a space and the text, B a piece vocabulary that puts the space there itself. Both give
byte offsets where tokens end; where both end, a group ends. `align` walks the two arrays of ends by diagonal run skipping: as long as
tokens match one to one, ends are equal at a fixed shift between the indices, so runs of ends are compared at that shift, twice as many
each time, and the first difference is then searched by halving; an irregular group is resolved token by token, which gives its
links (pairs of tokens whose bytes overlap) and the new shift.

A task aligns documents in slices of bounded size and keeps, for a slice, its distinct linked id pairs and how often each document
holds them. Pairs are counted over slices (a document counts once), every slice gets the counts of its own pairs back, and
documents sum them up. So a pair sends one row for each slice, not for each document, and no key is hot.

Defined cases: texts that are NULL or empty, and texts whose joined bytes in either vocabulary differ from the space and the text, have no
tokens (zeros, empty digest); a row is a document, so rows that repeat count as often as they occur; a NULL doc_id comes
back as NULL; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut
from barloom.llm.tokens import BYTE_LETTERS, vocabulary_path

BYTES_VOCABULARY, PIECES_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_DOCUMENTS, SLICE_LETTERS = 2_000, 6_000_000
CACHE_ENTRIES = 400_000
LONG_UNIT = 64
SPACE_MARK = "▁"
#: The split pattern of the byte-level vocabulary (a fixed value), for the library that takes it as text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters whose class is the same in every Unicode version that the libraries may hold.
SETTLED = re.compile("[\x00-ſ‐-‧€]*")
UNIT = re.compile(" +[^ ]*")
A_SHIFT = 32
_tokenizers: dict[tuple[str, str], Pair] = {}


class ByteTokens:
    """Ids of tokenizer A. Its merges, if in id order, run in the faster of two libraries."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        letters = {c: b for b, c in enumerate(BYTE_LETTERS)}
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.fast = self._fast(whole, model)

    def _fast(self, whole: dict, model: dict):
        import tiktoken

        before = whole["pre_tokenizer"] or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get(a + b) for a, b in merges]
        if not usual or whole["normalizer"] or model.get("ignore_merges") or model.get("dropout") or ids != sorted(ids, key=lambda i: -1 if i is None else i) or None in ids or ids[:1] < [256]:
            return None
        ranks = {self.pieces[i]: i for i in model["vocab"].values() if i not in {t["id"] for t in whole["added_tokens"]}}
        if any(bytes([b]) not in ranks or ranks[bytes([b])] >= ids[0] for b in range(256)):
            return None
        return tiktoken.Encoding("aligned", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and SETTLED.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """Ids of tokenizer B. No piece holds a space after another letter, so spaces with the letters up to the next ones are encoded alone."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.apart = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        self.pieces = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.known: dict[str, bytes] = {}

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def whole(self, text: str) -> np.ndarray | None:
        ids = self.model.encode(text)
        return np.array(ids, np.int64) if self.joined(ids) == f" {text}".encode() else None

    def encode_all(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None where they do not give back the space and the text."""
        units = [UNIT.findall(f" {t}") if self.apart and SPACE_MARK not in t else None for t in texts]
        table = self.known
        if len(table) > CACHE_ENTRIES:
            table.clear()
        missing = list(set().union(*[u for u in units if u is not None]) - table.keys())
        # each unit begins with the space that the model adds; a lone space is added to a letter to be seen
        for unit, ids in zip(missing, self.model.encode([u[1:] for u in missing], num_threads=1) if missing else [], strict=True):
            if unit == " ":
                ids = self.model.encode("a ")[1:]
            table[unit] = np.array(ids, np.int32).tobytes() if self.joined(ids) == unit.encode() else b""
        out: list[np.ndarray | None] = []
        for text, mine in zip(texts, units, strict=True):
            found = None if mine is None else list(map(table.__getitem__, mine))
            if found is None or not all(found):
                out.append(self.whole(text))
            else:
                out.append(np.frombuffer(b"".join(found), np.int32).astype(np.int64))
        for unit in missing:
            if len(unit) > LONG_UNIT:
                del table[unit]
        return out


class Pair:
    """Both tokenizers, and the text of their ids with every separator."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        size = max(len(self.a.pieces), len(self.b.pieces))
        self.marked = [b"%d%c" % (i, c) for i in range(size) for c in b",|;"]


def tokenizers(a: str, b: str) -> Pair:
    """One pair for each worker process, so that its caches outlive a task."""
    if (a, b) not in _tokenizers:
        _tokenizers[a, b] = Pair(a, b)
    return _tokenizers[a, b]


class Aligned:
    """Groups of two arrays of ends: the index after the last token of each on both sides, and the links as index pairs."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        starts, shifts, lengths, after_a, after_b, link_a, link_b = align(ends_a, ends_b)
        sizes = np.array(lengths, np.int64)
        run = np.repeat(np.array(starts, np.int64) - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64), sizes) + np.arange(sizes.sum())
        other = run + np.repeat(np.array(shifts, np.int64), sizes)
        self.after_a = np.sort(np.concatenate([run + 1, np.array(after_a, np.int64)]))
        self.after_b = np.sort(np.concatenate([other + 1, np.array(after_b, np.int64)]))
        self.link_a = np.concatenate([run, np.array(link_a, np.int64)])
        self.link_b = np.concatenate([other, np.array(link_b, np.int64)])


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list[int], ...]:
    """One-to-one runs (first index of A, shift to B, length), irregular groups (indices after them) and their links."""
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.astype(np.int64).tobytes(), ends_b.astype(np.int64).tobytes()
    n = len(a)
    starts: list[int] = []
    shifts: list[int] = []
    lengths: list[int] = []
    after_a: list[int] = []
    after_b: list[int] = []
    link_a: list[int] = []
    link_b: list[int] = []
    i, shift = 0, 0
    while i < n:
        x, y = a[i], b[i + shift]
        if x == y:
            # probe: stretches of one, two, four ... ends at this shift; then halve the one that differs
            size, at, apart = 1, i + 1, 8 * shift
            while at + size <= n and raw_a[8 * at : 8 * (at + size)] == raw_b[8 * at + apart : 8 * (at + size) + apart]:
                at += size
                size *= 2
            while size > 1:
                size //= 2
                if at + size <= n and raw_a[8 * at : 8 * (at + size)] == raw_b[8 * at + apart : 8 * (at + size) + apart]:
                    at += size
            starts.append(i)
            shifts.append(shift)
            lengths.append(at - i)
            i = at
        else:
            j = i + shift
            link_a.append(i)
            link_b.append(j)
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
                link_a.append(i)
                link_b.append(j)
            i += 1
            after_a.append(i)
            after_b.append(j + 1)
            shift = j + 1 - i
    return starts, shifts, lengths, after_a, after_b, link_a, link_b


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned, marked: list[bytes]) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group on both sides."""
    size_a, size_b = np.diff(found.after_a, prepend=0), np.diff(found.after_b, prepend=0)
    place_a = np.arange(len(ids_a)) + np.repeat(found.after_b - size_b, size_a)
    place_b = np.arange(len(ids_b)) + np.repeat(found.after_a, size_b)
    codes_a, codes_b = 3 * ids_a, 3 * ids_b
    codes_a[found.after_a - 1] += 1
    codes_b[found.after_b - 1] += 2
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[place_a], codes[place_b] = codes_a, codes_b
    return b"".join(map(marked.__getitem__, codes.tolist()))[:-1]


def align_texts(pair: Pair, texts: list[str | None]) -> list[tuple | None]:
    """(ids of A, ids of B, Aligned) of each text, None for texts without tokens."""
    pieces = iter(pair.b.encode_all([t for t in texts if t]))
    out: list[tuple | None] = []
    for text in texts:
        right = next(pieces) if text else None
        if right is None:
            out.append(None)
            continue
        left = pair.a.encode(f" {text}")
        ends_a, ends_b = np.cumsum(pair.a.lengths[left]), np.cumsum(pair.b.lengths[right])
        same = ends_a[-1] == ends_b[-1]
        out.append((left, right, Aligned(ends_a, ends_b)) if same else None)
    return out


SLICES = (
    "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "sizes array<int>, pairs binary, holds binary, times binary"
)


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    ids, texts, letters = [], [], 0
    for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py()
        if ids and (len(ids) >= SLICE_DOCUMENTS or letters + len(text or "") > SLICE_LETTERS):
            yield ids, texts
            ids, texts, letters = [], [], 0
        ids.append(one)
        texts.append(text)
        letters += len(text or "")
    if ids:
        yield ids, texts


def aligned_slices(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each slice of documents: their figures, the slice's distinct pairs, and which pair each document holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(a, b)
        for batch in batches:
            for ids, texts in _slices(batch):
                rows, held, times = [], [], []
                for found in align_texts(pair, texts):
                    if found is None:
                        rows.append((0, 0, 0, 0, "", 0))
                        continue
                    left, right, groups = found
                    codes, n = np.unique((left[groups.link_a] << A_SHIFT) | right[groups.link_b], return_counts=True)
                    held.append(codes)
                    times.append(n)
                    sha = hashlib.sha256(groups_text(left, right, groups, pair.marked)).hexdigest()
                    rows.append((len(left), len(right), len(groups.after_a), int(n.sum()), sha, len(codes)))
                pairs, at = np.unique(np.concatenate(held), return_inverse=True) if held else (np.zeros(0, np.int64),) * 2
                n = np.concatenate(times) if times else np.zeros(0, np.int64)
                lists = [list(c) for c in zip(*rows, strict=True)]
                columns = [pa.array([v], pa.list_(pa.string() if k == 4 else pa.int32() if k == 5 else pa.int64())) for k, v in enumerate(lists)]
                blobs = [pa.array([_pack(v)], pa.binary()) for v in (np.diff(pairs, prepend=0), at.astype(np.int32), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *columns, *blobs], names=[c.split()[0] for c in SLICES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SLICES)


def _pair_rows(slices: DataFrame) -> DataFrame:
    """slice, place, pair and n (documents of the slice that hold the pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, pairs, holds in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                values = np.cumsum(_unpack(pairs, np.int64))
                n = np.bincount(_unpack(holds, np.int32), minlength=len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), one, np.int64)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values), pa.array(n.astype(np.int32))],
                    names=["slice", "place", "pair", "n"],
                )

    return slices.select("slice", "pairs", "holds").mapInArrow(run, "slice long, place int, pair long, n int")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (documents that hold it) and best (whether no other pair of its A id has a higher count)."""
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    first = F.shiftright("pair", A_SHIFT)
    highest = counts.groupBy(first.alias("a")).agg(F.max("count").alias("highest"))  # at most a row for each id of A
    joined = counts.join(F.broadcast(highest), first == F.col("a"))
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_documents(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    slices = cut(aligned_slices(docs, a or vocabulary_path(BYTES_VOCABULARY), b or vocabulary_path(PIECES_VOCABULARY)))
    slices = slices.withColumn("slice", F.monotonically_increasing_id())  # of written partitions, so the same at every reading
    rows = _pair_rows(slices).repartition("pair")
    rated = rows.join(pair_counts(rows), "pair")
    value = F.shiftleft("count", 1).bitwiseOR(F.col("best").cast("long"))
    back = rated.groupBy("slice").agg(F.collect_list(F.struct("place", value.alias("value"))).alias("rated"))
    names = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lists = [batch.column(i)[k].values for i in range(7)]
                sizes = lists[6].to_numpy()
                best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                if sizes.sum():
                    holds, times = (_unpack(batch.column(i)[k].as_py(), np.int32) for i in (7, 8))
                    answers = batch.column(9)[k].values
                    values = np.zeros(len(answers), np.int64)
                    values[answers.field(0).to_numpy()] = answers.field(1).to_numpy()
                    mine = values[holds]
                    owner = np.repeat(np.arange(len(sizes)), sizes)
                    np.add.at(best, owner, times * (mine & 1))
                    np.add.at(total, owner, times * (mine >> 1))
                columns = [*lists[:5], pa.array(best), pa.array(total), lists[5]]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in names.split(", ")])

    order = [c.split()[0] for c in SLICES.split(", ") if not c.startswith("pairs")]
    return slices.join(back, "slice", "left").select(*order, "rated").mapInArrow(run, names)
