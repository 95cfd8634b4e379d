import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.normal import normal_cdf
from barloom.functions.tails import chi2_upper, student_t_two_sided
from barloom.operators import backtest, compare, explore, folds, metrics, quantiles
from tests.conftest import table

PLAN = dict(train_start="2018-01-01", first_test_start="2018-07-01", test_months=1, step_months=1, min_train_rows=100)


@pytest.mark.parametrize("embargo", [0, 5, 20])
def test_fold_gaps(gapped, embargo):
    plan = folds.FoldPlan(embargo_days=embargo, **PLAN)
    f = folds.walk_forward_folds(gapped, plan)
    audit = table(folds.integrity_audit(folds.assign_splits(gapped, f), plan), "fold")
    assert len(audit) >= 2 and audit["ok"].all() and list(audit["fold"]) == list(range(len(audit)))


def test_fold_plan_rejects_bad_settings():
    with pytest.raises(ValueError):
        folds.FoldPlan(scheme="sliding", **PLAN)
    with pytest.raises(ValueError):
        folds.FoldPlan(inner_val_frac=0.6, **PLAN)


@pytest.mark.parametrize("accuracy", [3, 50, 10_000])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    """The sketch only proposes cut points: a very rough one gives the same exact results."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    values = {"a": np.r_[rng.normal(size=3000), np.full(2000, 0.25)], "b": rng.integers(0, 9, 1501).astype(float)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.01, 0.5, 0.99])
    for r in got.collect():
        assert abs(r["q"] - np.quantile(values[r["k"]], r["prob"])) < 1e-12


def test_roc_auc_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    s = np.round(0.5 + rng.normal(0, 1e-4, 400), 5)
    s[:150] = 0.5
    y = (rng.random(400) < 0.4).astype(float)
    rows = [("m", float(a), float(b)) for a, b in zip(y, s)]
    got = metrics.roc_auc(spark.createDataFrame(rows, "model string, y double, s double"), ["model"], "y", "s").first()
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(got["roc_auc"] - want) < 1e-12


def test_single_class_groups_score_null(spark):
    rows = [(f"m{i % 2}", 1.0 if i % 2 else float(i % 3 == 0), 0.4 + i / 100, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "model string, y_true double, proba double, pred double")
    got = table(metrics.classification(df, ["model"]), "model")
    assert got["directional_accuracy"].notna().tolist() == [True, False] and np.isnan(got["roc_auc"][1])


def test_tail_probabilities(spark):
    assert abs(student_t_two_sided(np.array([2.2281388519649385]), np.array([10.0]))[0] - 0.05) < 1e-9
    assert abs(chi2_upper(np.array([11.070497693516351]), np.array([5.0]))[0] - 0.05) < 1e-9
    x = spark.createDataFrame([(1.959963984540054,), (-8.0,)], "x double").select(normal_cdf("x").alias("p")).collect()
    assert abs(x[0]["p"] - 0.975) < 1e-12 and abs(x[1]["p"] - 6.220960574271785e-16) < 1e-24


def _pairs(spark, n=60, assets=("A", "B")):
    rng = np.random.default_rng(5)
    rows = []
    for a in assets:
        for i in range(n):
            y, e, f = rng.normal(size=3)
            rows.append(("m", a, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(y), float(y + e), float(y + 1.2 * f)))
    return spark.createDataFrame(rows, "model string, asset string, date date, y double, a double, b double")


@pytest.mark.parametrize("h", [1, 4])
def test_diebold_mariano(spark, monkeypatch, h):
    monkeypatch.setattr(compare.blocks, "DEFAULT_BLOCK", 16)
    df = _pairs(spark)
    got = compare.diebold_mariano(df, ["model"], horizon=h).first()
    p = df.toPandas().sort_values(["asset", "date"])
    d = ((p.y - p.a) ** 2 - (p.y - p.b) ** 2).to_numpy()
    n, dc = len(d), d - d.mean()
    lr = dc @ dc / n + 2 * sum(dc[k:] @ dc[:-k] / n for k in range(1, h))
    want = d.mean() / np.sqrt(lr / n) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    assert abs(got["dm_statistic"] - want) < 1e-9 and 0 <= got["p_value"] <= 1


def test_degenerate_comparisons_are_ties(spark):
    df = _pairs(spark).withColumn("b", F.col("a"))
    got = compare.diebold_mariano(df, ["model"]).first()
    assert got["dm_statistic"] is None and got["better"] == "tie" and got["note"] == "forecasts are identical"


def test_seed_disagreement_is_flat(spark):
    rows = [("A", dt.date(2020, 1, 1), p, "m", s, 1.0) for s, p in ((0, 0.6), (1, 0.4))]
    df = spark.createDataFrame(rows, "asset string, date date, proba double, model string, seed int, y_true double")
    assert backtest.positions_for(df).first()["position"] == 0.0


def test_backtest_against_a_loop(spark):
    rng = np.random.default_rng(9)
    days, assets = 150, ("A", "B", "C")
    pos = {a: rng.choice([-1.0, 0.0, 1.0], days) for a in assets}
    fwd = {a: rng.normal(0, 0.03, days) for a in assets}
    rows = [("m", a, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(pos[a][i]), float(fwd[a][i])) for a in assets for i in range(days)]
    df = spark.createDataFrame(rows, "model string, asset string, date date, position double, forward_return double")
    got = table(backtest.cost_sweep(df, ["model"], [0.0, 20.0]), "strategy", "cost_bps")
    net, prev = [], dict.fromkeys(assets, 0.0)
    for i in range(days):
        active = sum(pos[a][i] != 0 for a in assets)
        w = {a: pos[a][i] / active if active else 0.0 for a in assets}
        turn = sum(abs(w[a] - prev[a]) for a in assets)
        net.append(sum(w[a] * fwd[a][i] for a in assets) - turn * 10 / 1e4)
        prev = w
    equity = np.cumprod(1 + np.array(net))
    row = got[(got.strategy == "model") & (got.cost_bps == 20.0)].iloc[0]
    assert abs(row.total_return - (equity[-1] - 1)) < 1e-12
    peak, start, longest, under = 1.0, 0, 0, False
    for i, v in enumerate(equity):
        if v >= peak:
            longest, peak, start, under = max(longest, i - start if under else 0), v, i, False
        else:
            under = True
    open_span = days - 1 - start if under else -1
    assert row.max_drawdown_days == max(longest, open_span)
    assert row.max_drawdown_unrecovered == (open_span >= longest)
    hold = got[got.strategy == "buy_and_hold"].iloc[0]
    want = np.prod([1 + np.mean([fwd[a][i] for a in assets]) for i in range(days)]) - 1
    assert abs(hold.total_return - want) < 1e-12


def test_pacf_and_adf(panel):
    x = np.random.default_rng(0).normal(size=400)
    assert explore.adf_statistic(x)[0] < -10 and explore.adf_statistic(np.cumsum(x))[0] > -3.5
    rho = 0.6 ** np.arange(1, 6)
    np.testing.assert_allclose(explore._durbin_levinson(rho), [0.6, 0, 0, 0, 0], atol=1e-12)
