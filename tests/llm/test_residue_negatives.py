"""Residue products against exact integers, and mining against a plain version."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.llm import residue_negatives as rn


@pytest.mark.parametrize(("size", "width"), [(3, 5), (160, 64), (10_000, 3_000), (1 << 27, 40)])
def test_products_are_exact(size, width):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (7, width)), rng.integers(-size, size + 1, (9, width))
    a[0], b[0], b[1] = size, size, -size
    residues = rn.Residues(size * size * width)
    got = residues.scores(residues.split(a.astype(float)), residues.split(b.astype(float)))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert got.tolist() == want


def test_too_large_scores_raise():
    with pytest.raises(ValueError):
        rn.Residues(1 << 61)


def plain(rows):
    """Plain version for rows (vec_id, label, vector) with distinct ids."""
    fine = [(i, l, v) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, _, v in fine]
    usual = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    fine = [((l + 1) % 10 if i % 7 == 0 else l, i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in fine if len(v) == usual]
    out = []
    for own, anchor, q in fine:
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, l) for l, i, v in fine)
        for minus, positive, _ in [s for s in scored if s[2] == own and s[1] != anchor][:5]:
            p = -minus
            inside = [s for s in scored if s[2] != own and 30 * p <= -100 * s[0] <= 90 * p][:10]
            out += [(anchor, positive, k, n, p, -s) for k, (s, n, _) in enumerate(inside, 1)]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return sorted(tuple(r) for r in rn.mine(rn.relabelled(frame)).collect())


@pytest.mark.parametrize("blocks", [1_024, 64])
def test_against_a_plain_version(spark, monkeypatch, blocks):
    monkeypatch.setattr(rn, "LEAST_BLOCK", blocks)
    monkeypatch.setattr(rn, "CELLS", 8 * blocks)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(k, int(rng.integers(0, 4)), (base[rng.integers(12)] + rng.normal(size=8) * rng.integers(0, 2)).tolist()) for k in range(0, 900, 2)]
    assert run(spark, rows) == plain(rows) != []


def test_defined_cases(spark):
    one, two, less = [0.5, 0.25], [0.5, 0.2], [0.3, 0.2]
    rows = [
        (0, 1, one), (2, 1, one), (4, 2, two), (6, 2, two), (8, None, one), (10, 2, None), (12, 2, [0.1, None]), (16, 2, [float("nan"), 1.0]),
        (18, 2, [float("inf"), 1.0]), (None, 2, two), (20, 2, [1.0]), (100, 2, [-0.5, -0.2]), (200, 9, one), (300, 3, [0.0, 0.0]), (22, 5, [0.25, 0.1]),
    ]
    assert run(spark, rows) == plain([r for r in rows if r[0] is not None]) != []
    assert run(spark, []) == [] and run(spark, [(1, None, None)]) == []
    twice = run(spark, [(100, 1, one), (100, 1, one), (2, 1, one), (4, 2, less), (4, 2, less)])
    assert [r[:4] for r in twice] == [(100, 2, 1, 4), (100, 2, 2, 4)]
    extra = spark.createDataFrame([(100, 1, one, 0, 0), (2, 1, one, 0, 0), (4, 2, less, 0, 0)], "vec_id long, label int, embedding array<float>, score int, anchor_id int")
    assert len(rn.mine(extra).collect()) == 1
