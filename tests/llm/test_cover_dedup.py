"""Substring removal against a brute-force version, and the cover property."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from barloom.llm import cover_dedup
from barloom.llm.common import WORD

SF = "/root/testdata/sf0.001"


def brute(rows, window=20):
    """(doc_id, n_words, n_removed, sha) of rows (doc_id, text): every window looked up in a table of first starts."""
    lists = [(d, WORD.findall(t or "")) for d, t in rows]
    order = {None: -(1 << 63)}
    first = {}
    for d, words in lists:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, (1 << 63, 0)), (order.get(d, d),))
    out = []
    for d, words in lists:
        gone, seen = set(), set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if first[key][0] < order.get(d, d) or key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in cover_dedup.digests(docs).collect()), key=str)


def test_every_pair_of_places_shares_a_shift():
    for period, places in cover_dedup.COVERS.items():
        inside = {p % period for p in places}
        for p in range(period):
            for q in range(period):
                assert any((p + d) % period in inside and (q + d) % period in inside for d in range(period))


def test_rolling_hash_depends_on_every_word():
    h = cover_dedup.hashes(b" ".join(b"w%d" % i for i in range(60)))
    for length in (1, 8, 13, 20):
        runs = cover_dedup.rolling(h, length)
        assert len(runs) == 61 - length
        for k in range(60):
            other = h.copy()
            other[k] += np.uint64(1)
            changed = np.flatnonzero(cover_dedup.rolling(other, length) != runs)
            assert changed.tolist() == list(range(max(0, k - length + 1), min(k, 60 - length) + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_at_all_shifts(spark, seed):
    rng = np.random.default_rng(seed)
    passages = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate((19, 20, 21, 33, 60))]
    rows = []
    for d in range(60):
        words = [f"d{d}w{i}" for i in range(rng.integers(0, 30))]
        for _ in range(rng.integers(0, 4)):
            words += passages[rng.integers(len(passages))] + [f"d{d}y{rng.integers(99)}" for _ in range(rng.integers(0, 20))]
        rows.append((int(d), " ".join(words)))
    rows += [(500 + i, " ".join("ab"[j] for j in rng.integers(0, 2, 400))) for i in range(2)]  # few different words
    assert result(spark, rows) == brute(rows)


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(40))
    same = "a " * 50
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (5, long), (5, "z " + long), (None, long + " end"), (6, same), (7, "short text"),
            (8, "\u00a0".join(f"n{i}" for i in range(30))), (9, "\x1f \x85 \x0b\x0c" + long.replace(" ", "\x0b"))]
    assert result(spark, rows) == brute(rows)
    assert result(spark, [(1, None)]) == brute([(1, None)])
    assert cover_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    extra = spark.createDataFrame([(1, long, 1, 2, 3), (2, long, 1, 2, 3)], "doc_id long, text string, id int, shared int, x int")
    assert [r.n_removed for r in cover_dedup.remove_repeats(extra).selectExpr("doc_id", "cast(aggregate(removed, 0, (s, r) -> s + r.stop - r.start) as int) n_removed").orderBy("doc_id").collect()] == [0, 40]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in cover_dedup.digests(docs).collect()), key=str) == brute(rows)


def test_word_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 101, rng.integers(1, 9)).astype(np.uint8)) for _ in range(4000)] + [b"\xc3\xa4", b"x" * 300]
    spaces = [b" ", b"\n\n", b"\t ", b"\x0b", b"\x0c\r"]
    text = b"".join(w + spaces[rng.integers(5)] for w in words)
    found = cover_dedup.hashes(text)
    assert text.split() == words and len(found) == len(words)
    table = dict(zip(words, found.tolist(), strict=True))
    assert [table[w] for w in words] == found.tolist() and len(set(table.values())) == len(table)
    monkeypatch.setattr(cover_dedup, "PIECE", 256)
    small = cover_dedup.hashes(text)
    assert (small[:-1] == found[:-1]).all() and len(small) == len(found)
    assert cover_dedup.hashes(words[-1] + b" a")[0] == small[-1] == cover_dedup.hashes(b"b " * 200 + words[-1])[-1]


def test_an_anchor_known_in_the_task_is_dealt_by_document():
    x, ids = cover_dedup.put_together(np.array([7, 5, 7, 7]), np.array([1, 1, 2, 3]))
    assert (x >> 2).tolist() == [5, 7, 7, 7]
    assert (x & 3).tolist() == [cover_dedup.SINGLE, cover_dedup.SEVERAL, cover_dedup.KNOWN, cover_dedup.KNOWN]
    assert ids.tolist() == [1, 1, 2, 3]
