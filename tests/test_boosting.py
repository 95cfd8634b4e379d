"""Boosted trees: a planted split, one block against many, best-first growth, stopping, causality and scopes."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import boosting
from tests.conftest import table

SCHEMA = "fold int, split string, asset string, date date, x array<double>, y double"


def make_rows(n=900, assets=("A", "B"), fold=0, seed=1, binary=True, flip=False):
    rng = np.random.default_rng(seed)
    rows = []
    for a in assets:
        for i in range(n):
            x = rng.normal(size=4)
            split = "train" if i < 0.6 * n else "val" if i < 0.8 * n else "test"
            up = (x[1] > 0.3) != (flip and a == "B")
            y = float(up) if binary else float(up) + 0.1 * rng.normal()
            rows.append((fold, split, a, dt.date(2015, 1, 1) + dt.timedelta(days=i), x.tolist(), y))
    return rows


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA)
    more = {"seeds": (0, 1), "rounds": 40, "patience": 10, **more}
    found, gains = boosting.fit_predict(frame, ["a", "b", "c", "d"], "trees", "dir_1d", **more)
    return table(found, "model", "fold", "seed", "asset", "date"), table(gains, "model", "fold", "scope", "seed", "feature")


def test_planted_split_in_both_scopes(spark):
    found, gains = run(spark, make_rows(flip=True))
    hit = lambda m: ((found[found.model == m].proba > 0.5) == (found[found.model == m].y_true > 0.5)).mean()
    assert hit("trees_per_asset") > 0.95
    own = gains[gains.model == "trees_per_asset"]
    assert (own.loc[own.groupby(["scope", "seed"])["gain"].idxmax()].feature == "b").all()
    assert sorted(gains.scope.unique()) == ["*", "A", "B"] and len(found) == 2 * 2 * 360


@pytest.mark.parametrize("binary", [True, False])
def test_many_blocks_grow_the_same_trees(spark, monkeypatch, binary):
    rows = make_rows(700, binary=binary) + make_rows(500, fold=1, seed=2, binary=binary)
    args = {"rounds": 9, "patience": 4, "classify": binary, "seeds": (0, 3), "min_rows": 400}
    one, gains = run(spark, rows, **args)
    monkeypatch.setattr(boosting, "BLOCK", 450)
    monkeypatch.setattr(boosting, "REFRESH", 4)
    many, again = run(spark, rows, **args)
    assert one.pred.isna().sum() == many.pred.isna().sum() > 0
    np.testing.assert_allclose(many.pred.astype(float), one.pred.astype(float), rtol=1e-9)
    assert (again.rounds == gains.rounds).all()
    np.testing.assert_allclose(again.gain.astype(float), gains.gain.astype(float), rtol=1e-9, atol=1e-12)


def test_best_first_keeps_the_largest_gains():
    tree = boosting.Tree()
    tree.feature[:15] = 0
    tree.gain[:15] = [9, 8, 1, 7, 6, 0.5, 0.4, 5, 4, 3, 2, 20, 0.3, 0.2, 0.1]
    tree.best_first()
    # the large gain below a weak split is reached only through it; of 15 candidates one is left out
    assert (tree.feature >= 0).sum() == boosting.LEAVES - 1 and tree.feature[14] < 0


def test_patience_ends_and_keeps_the_best_round(spark):
    rng = np.random.default_rng(0)
    rows = [(*r[:5], float(rng.integers(0, 2))) for r in make_rows()]
    _, gains = run(spark, rows, rounds=60, patience=5, seeds=(0,))
    assert gains.rounds.max() < 55
    stop = boosting.Stopper(2)
    told = [stop.better(v, i) for i, v in enumerate([3.0, 2.0, 2.5])]
    assert told == [True, True, False] and not stop.done(2) and stop.done(3) and stop.at == 1


def test_forecasts_ignore_test_rows_and_order(spark):
    rows = make_rows(400)
    changed = [(*r[:4], [v + 5 for v in r[4]], 1 - r[5]) if r[1] == "test" and r[3].day > 15 else r for r in rows]
    a, _ = run(spark, rows, seeds=(0,), min_rows=100)
    b, _ = run(spark, changed[::-1], seeds=(0,), min_rows=100)
    early = a.date.map(lambda d: d.day <= 15)
    assert early.any() and (a[early].proba == b[early].proba).all()


def test_small_and_constant_scopes_have_no_forecast(spark):
    rows = make_rows(400) + [(0, r[1], "C", *r[3:5], 1.0) for r in make_rows(300, assets=("C",))] + [(7, "test", "A", dt.date(2020, 1, 1), [0.0] * 4, 1.0)]
    found, gains = run(spark, rows, min_rows=100, seeds=(0,))
    own = found[found.model == "trees_per_asset"]
    assert own[own.asset == "C"].pred.isna().all() and own[(own.asset == "A") & (own.fold == 0)].pred.notna().all()
    assert found[found.fold == 7].pred.isna().all() and set(gains.scope) == {"*", "A", "B"}
