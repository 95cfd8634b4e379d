"""The windowed linear fit from lag summaries against the explicit design."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import lagged
from tests.conftest import table

LOOKBACK, WIDTH, KERNEL = 6, 3, 3


def make_rows(seed=3, assets=("A", "B", "C"), gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for a in assets:
        length = int(rng.integers(70, 90))
        x = rng.normal(size=(length, WIDTH))
        for i in range(length):
            split = "train" if i < 40 else "val" if i < 55 else "test"
            y = float(x[i, 0] - 0.5 * x[max(i - 2, 0), 1] + rng.normal() * 0.1 + ord(a))
            missing = gaps and i in (11, 12, 30, 47)
            rows.append((0, split, a, dt.date(2020, 1, 1) + dt.timedelta(days=i), x[i].tolist(), None if missing else y))
    return rows


def explicit(rows, alphas):
    """Windows, trend and seasonal parts written out; offsets by centring; ridge over both parts."""
    train, val, test = {}, {}, {}
    for a in sorted({r[2] for r in rows}):
        mine = [r for r in rows if r[2] == a]
        x = np.array([r[4] for r in mine])
        padded = np.vstack([np.zeros((LOOKBACK, WIDTH)), x])
        m = lagged.moving_average(LOOKBACK, KERNEL)
        for i, r in enumerate(mine):
            w = padded[i + 1 : i + 1 + LOOKBACK]
            v = np.concatenate([(m @ w).ravel(), (w - m @ w).ravel()])
            part = {"train": train, "val": val, "test": test}[r[1]]
            if r[5] is not None or r[1] == "test":
                part.setdefault(a, []).append((v, r[5], r[3]))
    means = {a: (np.mean([v for v, *_ in t], axis=0), np.mean([y for _, y, _ in t])) for a, t in train.items()}
    centred = lambda part: [(v - means[a][0], y - means[a][1]) for a, t in part.items() for v, y, _ in t]
    x, y = (np.array(c) for c in zip(*centred(train)))
    xv, yv = (np.array(c) for c in zip(*centred(val)))
    fits = [(a, np.linalg.solve(x.T @ x + a * np.eye(x.shape[1]), x.T @ y)) for a in alphas]
    alpha, w = min(fits, key=lambda f: ((yv - xv @ f[1]) ** 2).sum())
    return alpha, {(a, d): means[a][1] + (v - means[a][0]) @ w for a, t in test.items() for v, _, d in t}


@pytest.mark.parametrize("fan", [8, 2])
def test_pooled_and_own_fits_equal_the_explicit_design(spark, monkeypatch, fan):
    monkeypatch.setattr(lagged, "FAN", fan)
    rows, alphas = make_rows(assets=("A", "B", "C", "D", "E")), (0.1, 1.0, 10.0)
    frame = spark.createDataFrame(rows, "fold int, split string, asset string, date date, x array<double>, y double")
    coefs = lagged.fit(frame, LOOKBACK, KERNEL, alphas, min_rows=30)
    got = table(lagged.predict(frame, coefs, "dlinear", "ret_1d", LOOKBACK), "model", "asset", "date")
    chosen = {r.scope: r.alpha for r in coefs.collect()}
    alpha, want = explicit(rows, alphas)
    pooled = got[got.model == "dlinear"]
    assert chosen["*"] == alpha and len(pooled) == len(want)
    np.testing.assert_allclose(pooled.pred.astype(float), [want[r.asset, r.date] for r in pooled.itertuples()], rtol=1e-9)
    for a in ("A", "B"):
        alpha, want = explicit([r for r in rows if r[2] == a], alphas)
        own = got[(got.model == "dlinear_per_asset") & (got.asset == a)]
        assert chosen[a] == alpha
        np.testing.assert_allclose(own.pred.astype(float), [want[a, r.date] for r in own.itertuples()], rtol=1e-9)


def test_small_scopes_and_unseen_assets(spark):
    rows = make_rows(assets=("A", "B"), gaps=False)
    rows += [(0, "test", "new", dt.date(2020, 3, 20), [0.0] * WIDTH, 1.0)]
    frame = spark.createDataFrame(rows, "fold int, split string, asset string, date date, x array<double>, y double")
    coefs = lagged.fit(frame, LOOKBACK, KERNEL, min_rows=41)
    assert [r.scope for r in coefs.collect()] == ["*"]
    got = table(lagged.predict(frame, coefs, "dlinear", "ret_1d", LOOKBACK), "model", "asset", "date")
    assert got[got.model == "dlinear_per_asset"].pred.isna().all()
    new = got[(got.model == "dlinear") & (got.asset == "new")]
    assert len(new) == 1 and abs(float(new.pred.iloc[0]) - coefs.first()["intercept"]) < 1e-12


def test_a_triangular_factor_keeps_the_products():
    rng = np.random.default_rng(0)
    z, y = rng.normal(size=(400, 2)), rng.normal(size=400)
    parts = [lagged.summarise(z, y, np.arange(400) % 9 != k, 3) for k in range(3)]
    whole = lagged.merge(parts)
    assert len(whole.plus) <= 6
    np.testing.assert_allclose(lagged.products(whole), sum(lagged.products(p) for p in parts), atol=1e-9)
