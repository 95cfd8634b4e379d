import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import baselines, folds, linear, scaling, sequences, timeseries
from barloom.operators.targets import add_meta, add_targets
from barloom.plans.session import cut_lineage
from tests.conftest import make_panel, table
from barloom.schema import PANEL_SCHEMA

PLAN = folds.FoldPlan(train_start="2018-01-01", first_test_start="2019-08-01", test_months=2, step_months=3, min_train_rows=100)


@pytest.fixture(scope="module")
def members(spark):
    pdf = make_panel(days=720, seed=11)
    rows = add_targets(add_meta(spark.createDataFrame(pdf, PANEL_SCHEMA))).filter("vol_1d is not null and ret_lag1 is not null")
    return cut_lineage(folds.assign_splits(rows, folds.walk_forward_folds(rows, PLAN)))


def test_scaler_learns_from_training_rows_only(members):
    stats = table(scaling.fit_scaler(members, ["volume"]), "fold")
    train = members.filter("split = 'train' and fold = 0").toPandas()["volume"]
    lo, hi = train.quantile(0.01), train.quantile(0.99)
    clipped = train.clip(lo, hi)
    row = stats[stats.fold == 0].iloc[0]
    np.testing.assert_allclose([row.lo, row.hi, row["median"], row["mean"], row.sd],
                               [lo, hi, clipped.median(), clipped.mean(), clipped.std(ddof=0)], rtol=1e-10)


def test_ridge_matches_the_normal_equations(members):
    cols = ["ret_lag1", "realised_var_now"]
    rows = linear.design(members, cols, "ret_1d")
    got = linear.fit_ridge_pooled(rows, alphas=(10.0,)).filter("fold = 0").first()
    p = members.filter("fold = 0 and split = 'train'").toPandas()
    x, y = p[cols].to_numpy(), p["ret_1d"].to_numpy()
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ (y - y.mean()))
    np.testing.assert_allclose(got["coef"], w, rtol=1e-8)


def test_per_asset_scope_and_floor(spark):
    rng = np.random.default_rng(4)
    rows = []
    for asset, sign in (("A", 1), ("B", -1)):
        for i in range(460):
            x = float(rng.normal())
            split = "train" if i < 380 else "val" if i < 400 else "test"
            rows.append((0, split, asset, dt.date(2020, 1, 1) + dt.timedelta(days=i), [x], float(sign * x > 0)))
    df = spark.createDataFrame(rows, "fold int, split string, asset string, date date, x array<double>, y double")
    pooled = linear.predict(df, linear.fit_logistic_pooled(df, 1), "ridge", "dir_1d", True)
    own = linear.predict(df, linear.fit_logistic_per_asset(df, min_rows=300), "ridge_per_asset", "dir_1d", True)
    hit = lambda p: p.agg(F.avg((F.col("pred") == F.col("y_true")).cast("double"))).first()[0]
    assert hit(own) > 0.95 > 0.7 > hit(pooled)
    none = linear.predict(df, linear.fit_logistic_per_asset(df), "ridge_per_asset", "dir_1d", True)
    assert none.filter("pred is not null").isEmpty() and none.count() == 120


def _bumped(members, cut):
    """The same rows with every return and variance after ``cut`` distorted."""
    late = F.col("date") > F.lit(cut).cast("date")
    return cut_lineage(
        members.withColumn("ret_lag1", F.when(late, F.col("ret_lag1") * 3 + 0.01).otherwise(F.col("ret_lag1")))
        .withColumn("realised_var_now", F.when(late, F.col("realised_var_now") * 5).otherwise(F.col("realised_var_now")))
    )


@pytest.mark.parametrize(
    "forecast",
    [
        lambda m: timeseries.arma_predictions(m, "ret_1d", orders=(0, 1)),
        lambda m: timeseries.variance_predictions(m, "garch11"),
        lambda m: timeseries.variance_predictions(m, "egarch11"),
        baselines.vol_ewma,
        baselines.vol_trailing_mean,
    ],
)
def test_forecasts_ignore_the_future(members, forecast):
    first = members.filter("fold = 0")
    dates = [r[0] for r in first.filter("split = 'test'").select("date").distinct().orderBy("date").collect()]
    cut = str(dates[len(dates) // 2])
    until = F.col("date") <= F.lit(cut).cast("date")
    a = table(forecast(first).filter(until), "asset", "date")
    b = table(forecast(_bumped(first, cut)).filter(until), "asset", "date")
    # Calibration means are shuffled aggregates: the order of summation may differ.
    worst = np.abs(a["pred"] - b["pred"]).max()
    assert len(a) and worst <= 1e-12, worst


def test_unstable_variance_falls_back(members, monkeypatch):
    monkeypatch.setattr(timeseries, "is_stable", lambda *a: False)
    e = np.random.default_rng(0).normal(0, 0.02, 600)
    a, b, _ = timeseries.fit_variance(e, "garch11")
    assert 0 <= a <= 1 and 0 <= b <= 1
    h = timeseries.variance_path(e, 4e-4, "garch11", np.array([0.1]), np.array([0.8]))
    assert len(h) == 601 and abs(h[1, 0] - (4e-4 * 0.1 + 0.1 * e[0] ** 2 + 0.8 * 4e-4)) < 1e-12


def test_arithmetic_mean_is_above_geometric(members):
    a = table(baselines.vol_trailing_mean(members), "fold", "asset", "date")["pred"].mean()
    g = table(baselines.vol_climatology(members), "fold", "asset", "date")["pred"].mean()
    assert a > g


def test_arma_takes_only_stationary_fits_and_all_returns():
    rng = np.random.default_rng(9)
    r = rng.normal(0, 0.01, 3000)
    const, phi, theta, _ = timeseries.fit_arma(r)
    assert not len(phi) or np.abs(np.roots(np.r_[1.0, -phi])).max() < 1
    path = timeseries.arma_path(r[:50], 0.1, np.array([0.5, -0.2]), np.array([0.3]))
    forecast, shock, past = 0.1, 0.0, [0.0, 0.0]
    for k in range(50):
        shock, past = r[k] - forecast, [r[k], past[0]]
        forecast = 0.1 + 0.5 * past[0] - 0.2 * past[1] + 0.3 * shock
        assert abs(path[k] - forecast) < 1e-12


def test_window_offsets_cover_every_asset(members):
    m = members.filter("fold = 0")
    n = m.select("asset").distinct().count()
    x = sequences.window_design(m, ["ret_lag1"], "ret_1d", lookback=5).first()["x"]
    assert len(x) == 2 * 5 + n
