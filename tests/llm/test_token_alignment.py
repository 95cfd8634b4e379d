"""Alignment against a plain version that encodes whole texts with the libraries and compares byte ranges."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import token_alignment as ta
from barloom.llm.tokens import BYTE_LETTERS, vocabulary_path

SF = "/root/testdata/sf0.001"
A, B = vocabulary_path(ta.BYTES_VOCABULARY), vocabulary_path(ta.PIECES_VOCABULARY)


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows):
    left, right = libraries()
    letters = {c: b for b, c in enumerate(BYTE_LETTERS)}
    docs = []
    for one, text in rows:
        whole = f" {text or ''}".encode()
        encoded = left.encode(f" {text or ''}", add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens, strict=True)]
        b = []
        for i in right.encode(text or ""):
            piece = right.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            docs.append((one, [], [], [], []))
            continue
        ranges = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            ranges.append(out)
        links = [(x[0], y[0]) for x in ranges[0] for y in ranges[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in ranges[0]} & {y[2] for y in ranges[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if begin <= x[1] and x[2] <= end) for side in ranges))
            begin = end
        docs.append((one, a, b, groups, links))
    counts = Counter(p for d in docs for p in set(d[4]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(
        (
            (one, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
            for one, a, b, groups, links in docs
        ),
        key=str,
    )


def result(spark, rows, **more):
    return sorted((tuple(r) for r in ta.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()), key=str)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", " \n ", "a\n\n b\t", "don't  we'll", "x" * 300, "café naïve 中文 สวัส", "\U0001f600 ok",
    "<|endoftext|> <s> </s> <unk> <0x41>", "▁mark", "in▁side", "zero\u0000byte", " nb sp  em", "ﬁ ½ é Å", "tab\tand\r\nline \x1c\x1f\x85 end",
    "12345 6,789.00", "۱٢ ẞ ǅ", "﻿bom", "​zw‍",
]


def test_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(None, "a"), (4, "a"), (7, "a  ")]
    assert result(spark, rows) == plain(rows)


def test_empty_and_extra_columns(spark):
    assert ta.link_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert result(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]
    extra = spark.createDataFrame([(1, "some text", 1, 2, 3)], "doc_id long, text string, pair int, slice int, n_a int")
    assert [tuple(r) for r in ta.link_documents(extra).collect()] == plain([(1, "some text")])


@pytest.mark.parametrize("documents", [2_000, 3])
def test_table(spark, monkeypatch, documents):
    monkeypatch.setattr(ta, "SLICE_DOCUMENTS", documents)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900").limit(60)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(spark, rows) == plain(rows)


def test_ids_equal_the_libraries(monkeypatch):
    monkeypatch.setattr(ta, "CACHE_ENTRIES", 50)
    left, right = libraries()
    pair = ta.Pair(A, B)
    assert pair.a.fast is not None and pair.b.apart
    rng = np.random.default_rng(8)
    ranges = [(0, 0x180), (32, 127), (32, 127), (0x2010, 0x2028), (0x370, 0x2000), (0x3000, 0xA000)]
    for _ in range(40):
        texts = []
        for _ in range(10):
            low, high = ranges[rng.integers(len(ranges))]
            chars = rng.integers(low, high, rng.integers(1, 60))
            texts.append("".join(chr(c) if rng.random() < 0.8 else " '\n"[rng.integers(3)] for c in chars))
        for text, found in zip(texts, pair.b.encode_all(texts), strict=True):
            assert pair.a.encode(f" {text}").tolist() == left.encode(f" {text}", add_special_tokens=False).ids
            if found is not None:
                assert found.tolist() == right.encode(text)
            else:
                assert pair.b.joined(right.encode(text)) != f" {text}".encode()


def test_diagonal_runs(spark):
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = int(rng.integers(1, 300))
        inner = np.arange(1, size)
        ends = [np.append(inner[rng.random(size - 1) < share], size) for share in rng.choice([0.1, 0.5, 0.95, 1.0], 2)]
        found = ta.Aligned(*ends)
        both = np.intersect1d(*ends)
        assert ends[0][found.after_a - 1].tolist() == ends[1][found.after_b - 1].tolist() == both.tolist()
        union = np.union1d(*ends)
        want = set(zip(np.searchsorted(ends[0], union).tolist(), np.searchsorted(ends[1], union).tolist(), strict=True))
        assert set(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == want and len(found.link_a) == len(union)
