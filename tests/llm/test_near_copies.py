"""The pipeline's near-duplicate stage against Jaccard similarities of all pairs."""

from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
import pytest
from barloom.llm import near_copies

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def left_over(rows):
    """The ids that stay: the smallest of each component of pairs with a similarity of 0.8 or more."""
    owner = {}
    for doc_id, text in sorted(rows):
        owner.setdefault(shingles(text), doc_id)
    sets = list(owner)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large:
                both = len(sets[i] & sets[j])
                if 10 * both >= 8 * (small + large - both) > 0:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {owner[sets[i]] for i in range(len(sets)) if find(i) == i}


def test_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    want = left_over([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_copies_with_spread_edits_go_and_looser_ones_stay(spark, edits):
    rng = np.random.default_rng(edits)
    rows = []
    for k in range(20):
        words = [f"w{i}" for i in rng.integers(0, 5000, 60 * edits)]
        near, far = list(words), list(words)
        for i in range(edits):  # one change in 60 words touches five of 56 shingles or so; three changes, fifteen
            near[30 + 60 * i] = "changed"
            for j in (10, 30, 50):
                far[j + 60 * i] = "other"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near).upper()), (3 * k + 2, " ".join(far))]
    rows += [(None, rows[0][1]), (1000, None), (1001, " \n"), (1002, "one two"), (1003, "ONE  two"), (None, "alone here")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = left_over([r for r in rows if r[0] is not None])
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == ["alone here"]


def test_simhash_alone_finds_the_close_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "bucket_links", lambda owners: owners.select("fp", "fp").toDF("a", "b").limit(0))
    rng = np.random.default_rng(8)
    rows, want = [], []
    for k in range(6):
        words = [f"w{i}" for i in rng.integers(0, 5000, 2000)]
        near = [*words[:1000], "changed", *words[1001:]]
        apart = near_copies.simhash.majority(near_copies.shingle_set(" ".join(words))) ^ near_copies.simhash.majority(near_copies.shingle_set(" ".join(near)))
        want += [2 * k] if apart.bit_count() <= near_copies.RADIUS else [2 * k, 2 * k + 1]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    assert len(want) < len(rows)
    rows += [(20, "a b c d e a b c d e"), (21, "a b c d e a b c d e a b c d e"), (22, None), (23, " ")]  # one set, no set
    want += [20, 22]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == want
