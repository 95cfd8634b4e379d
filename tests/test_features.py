import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions.rolling import add_rolling
from barloom.functions.series import Series
from barloom.operators import audit, auxiliary, blocks, cross_asset, features
from barloom.operators.ewm import add_ewm, add_ewm_blocks
from barloom.operators.targets import add_targets
from tests.conftest import table


def test_targets_on_the_golden_panel(golden):
    t = table(add_targets(golden), "asset", "date")
    got = [None if pd.isna(v) else v for v in t["dir_1d"]]
    assert got == [1, 0, 0, 1, None, 0, 1, 1, 1, None]
    assert abs(t["ret_1d"][0] - math.log(110 / 100)) < 1e-12
    assert abs(t["fwd_ret_simple"][5] + 0.1) < 1e-12
    assert t["ret_1d"].isna().sum() == 2


def test_rolling_matches_pandas(panel):
    df = panel.withColumn("r", Series().diff(F.ln("close")))
    specs = {f"{s}_{n}": (s, "r", n) for s in ("sum", "mean", "std", "skew", "kurt", "min", "max") for n in (5, 7, 21, 63)}
    specs["corr_30"] = ("corr", ("r", "volume"), 30)
    got = table(add_rolling(df, Series(), specs), "asset", "date")
    for out, (stat, x, n) in specs.items():
        for _, g in got.groupby("asset"):
            if stat == "corr":
                want = g["r"].rolling(n).corr(g["volume"].where(g["r"].notna()))
            else:
                want = getattr(g["r"].rolling(n), stat)()
            np.testing.assert_allclose(g[out].to_numpy(float), want.to_numpy(float), rtol=1e-7, atol=1e-9)


def test_rolling_of_a_constant_has_no_spread(spark):
    df = spark.range(40).select(F.lit("a").alias("asset"), F.col("id").alias("date"), F.lit(12.3).alias("x"))
    out = add_rolling(df, Series(), {"sd": ("std", "x", 21), "z": ("zscore", "x", 21), "k": ("kurt", "x", 21)})
    last = out.orderBy(F.desc("date")).first()
    assert last["sd"] == 0.0 and last["z"] is None and last["k"] is None


def test_ewm_matches_the_recursion(panel):
    got = table(add_ewm(panel, {"e": ("close", 2 / 27), "w": ("close", 1 / 14)}), "asset", "date")
    for _, g in got.groupby("asset"):
        np.testing.assert_allclose(g["e"], g["close"].ewm(alpha=2 / 27, adjust=False).mean(), rtol=1e-12)
        np.testing.assert_allclose(g["w"], g["close"].ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-12)


def test_ewm_over_blocks_equals_the_recursion(spark):
    rng = np.random.default_rng(4)
    rows = []
    for asset, n, late, flat in (("a", 900, 0, 0), ("b", 333, 130, 0), ("c", 700, 1, 500), ("d", 5, 9, 0)):
        x = rng.lognormal(0, 1, n)
        x[n - flat:] = 0.0
        rows += [(asset, i, None if i < late else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "asset string, date int, x double")
    specs = {"quick": ("x", 0.4), "slow": ("x", 0.02)}
    for size in (7, 64, 1000):
        numbered = blocks.number_rows(df, ("asset",), ("date",), F.floor(F.col("date") / 50))
        got = table(add_ewm_blocks(numbered, specs, block_rows=size), "asset", "date")
        assert len(got) == len(rows)
        for out, (_, alpha) in specs.items():
            for _, g in got.groupby("asset"):
                want = g["x"].ewm(alpha=alpha, adjust=False).mean()
                np.testing.assert_allclose(g[out].to_numpy(float), want.to_numpy(float), rtol=1e-11, atol=0)


def test_technical_over_blocks_equals_whole_series(gapped):
    whole = table(features.add_technical(gapped), "asset", "date")
    cut = table(features.add_technical_blocks(gapped, bucket=F.trunc("date", "month"), block_rows=30), "asset", "date")
    assert list(whole.columns) == list(cut.columns) and len(whole) == len(cut)
    for c in whole.columns:
        if whole[c].dtype == float:
            np.testing.assert_allclose(whole[c].to_numpy(), cut[c].to_numpy(), rtol=1e-8, atol=1e-9)


def test_blocks_equal_whole_series(gapped):
    for build, halo in ((features.add_price, 91), (features.add_range_vol, 22)):
        whole = table(build(gapped), "asset", "date")
        cut = blocks.blockwise(gapped, build, halo=halo, bucket=F.trunc("date", "month"), block_rows=halo + 3)
        parts = table(cut, "asset", "date")
        assert len(whole) == len(parts)
        for c in whole.columns:
            if whole[c].dtype == float:
                np.testing.assert_allclose(whole[c].to_numpy(), parts[c].to_numpy(), rtol=1e-9, atol=1e-9)


def test_features_do_not_change_when_the_future_is_cut(gapped):
    cols = ["tech_rsi_14", "tech_macd_signal_norm", "tech_obv_zscore_21", "tech_stoch_d_14"]
    found = table(audit.causality_audit(features.add_technical, gapped, "2018-06-30", cols), "feature")
    assert (found["max_diff"] == 0).all() and (found["n_mismatch"] == 0).all()


def test_audit_catches_a_look_ahead(gapped):
    leaky = lambda p: p.withColumn("leak", Series().lead("close"))
    found = audit.causality_audit(leaky, gapped, "2018-06-30", ["leak"]).first()
    assert found["n_mismatch"] > 0


def test_leak_screen_flags_a_planted_leak(panel):
    m = add_targets(panel).withColumn("planted", F.col("ret_1d") * 2).withColumn("flat", F.lit(1.0))
    found = table(audit.leak_screen(m, ["planted", "flat", "volume"], ["ret_1d"]), "feature")
    assert list(found["flagged"]) == [True, True, False]


def test_cross_section_uses_the_panel_calendar(gapped):
    got = table(cross_asset.add_cross_asset(gapped, "BTC"), "asset", "date")
    pdf = gapped.toPandas().sort_values(["asset", "date"])
    r = np.log(pdf["close"]).groupby(pdf["asset"]).diff()
    wide = pdf.assign(r=r).pivot(index="date", columns="asset", values="r")
    lagged = wide.shift(1)
    for asset, g in got.groupby("asset"):
        dates = pd.Index(g["date"])
        np.testing.assert_allclose(g["xa_ref_ret_lag2"], wide["BTC"].shift(2).reindex(dates), atol=1e-12)
        np.testing.assert_allclose(g["xa_market_dispersion"], lagged.std(axis=1).reindex(dates), atol=1e-12)
        np.testing.assert_allclose(g["xa_rank_ret_lag1"], lagged.rank(axis=1, pct=True)[asset].reindex(dates), atol=1e-12)
        want = wide[asset].rolling(30).corr(wide["BTC"]).reindex(dates)
        np.testing.assert_allclose(g["xa_corr_ref_30"], want, atol=1e-8)


def test_smoothing_keeps_the_recursion_through_long_flat_runs(spark):
    from barloom.operators import ewm

    rng = np.random.default_rng(5)
    gain = np.r_[np.abs(rng.normal(0, 1, 40)), np.zeros(2500)]
    loss = np.r_[np.abs(rng.normal(0, 1, 40)), np.zeros(2500)]
    days = pd.date_range("2001-01-01", periods=len(gain)).date
    rows = spark.createDataFrame(pd.DataFrame({"asset": "A", "date": days, "gain": gain, "loss": loss}))
    got = ewm.add_ewm(rows, {"g": ("gain", 1 / 14), "l": ("loss", 1 / 14)}).toPandas().sort_values("date")
    g, l, want = gain[0], loss[0], []
    for k in range(len(gain)):
        if k:
            g, l = g * 13 / 14 + gain[k] / 14, l * 13 / 14 + loss[k] / 14
        want.append(g / l)
    assert np.allclose((got["g"] / got["l"]).to_numpy(float), want, rtol=1e-9)


def test_metrics_that_never_match_the_panel_are_left_out(golden):
    day = F.col("date")
    other = golden.select("asset", F.date_add(day, 400).alias("date"), F.lit(1.0).alias("far"), F.lit(2.0).alias("near"))
    here = golden.select("asset", "date", F.lit(None).cast("double").alias("far"), F.col("close").alias("near"))
    both = other.unionByName(here)
    assert auxiliary.matched_metrics(golden, both, ("far", "near")) == ["near"]
    assert auxiliary.matched_metrics(golden, both.limit(0), ("far", "near")) == []
