"""Queries over folds, scaling, baselines, metrics, comparisons and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import moments
from barloom.functions.expr import rounded
from barloom.operators import backtest, baselines, compare, folds, metrics, scaling
from barloom.operators.matrix import drop_warmup
from barloom.operators.targets import add_meta, add_targets
from barloom.plans import datasets as ds
from barloom.plans import evaltext as e
from barloom.plans import sqltext as q
from barloom.plans.registry import query
from barloom.plans.session import cut_lineage

SCALED = ("ret_lag1", "realised_var_now", "volume", "quote_volume", "close")


def modelling_rows(spark, sf, primary):
    return cut_lineage(drop_warmup(add_targets(add_meta(ds.panel(spark, sf))), ds.WARMUP, primary))


def member(spark, sf, primary, plan=ds.EXPANDING):
    rows = modelling_rows(spark, sf, primary)
    return folds.assign_splits(rows, cut_lineage(folds.walk_forward_folds(rows, plan)))


def predictions(spark, sf, target):
    m = member(spark, sf, target)
    if target != "vol_1d":
        return baselines.baselines_for(m, target)
    # Training statistics and forecasts read the membership, scores and tests the forecasts, several times.
    return cut_lineage(baselines.baselines_for(cut_lineage(m), target))


def seeded(spark, sf):
    """Direction predictions under two pseudo seeds."""
    p = predictions(spark, sf, "dir_1d").drop("seed")
    p = p.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    return p.withColumn("proba", F.col("proba") + (2 * F.col("seed") - 1) * 0.01)


# -- folds ------------------------------------------------------------------------

_DESCRIBE = ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c.startswith("n_") else c for c in folds.DESCRIBE
)


def _folds(plan):
    def run(spark, sf):
        rows = drop_warmup(add_targets(add_meta(ds.panel(spark, sf))), ds.WARMUP, "dir_1d")
        return folds.describe(folds.walk_forward_folds(rows, plan))

    return run


query("folds_expanding", f"WITH {e.folds('dir_1d')} SELECT {_DESCRIBE} FROM folds")(_folds(ds.EXPANDING))
query("folds_rolling", f"WITH {e.folds('dir_1d', ds.ROLLING)} SELECT {_DESCRIBE} FROM folds")(_folds(ds.ROLLING))


@query("split_membership", f"WITH {e.membership('dir_1d')} SELECT fold, split, asset, date FROM mem")
def split_membership(spark, sf):
    return member(spark, sf, "dir_1d").select("fold", "split", "asset", "date")


@query(
    "fold_audit",
    f"""WITH {e.membership('dir_1d')} SELECT fold, 0::BIGINT AS n_overlap,
  CAST(min(date) FILTER (WHERE split = 'val') - max(date) FILTER (WHERE split = 'train') AS BIGINT) AS inner_gap,
  CAST(min(date) FILTER (WHERE split = 'test') - max(date) FILTER (WHERE split = 'val') AS BIGINT) AS outer_gap,
  (min(date) FILTER (WHERE split = 'val') - max(date) FILTER (WHERE split = 'train') > 6) AND
  (min(date) FILTER (WHERE split = 'test') - max(date) FILTER (WHERE split = 'val') > 6) AS ok
  FROM mem GROUP BY fold""",
)
def fold_audit(spark, sf):
    return folds.integrity_audit(member(spark, sf, "dir_1d"), ds.EXPANDING)


# -- scaling ----------------------------------------------------------------------

_STATS = e.membership("dir_1d") + """,
lg AS (UNPIVOT (SELECT fold, split, asset, date, ret_lag1, realised_var_now, volume, quote_volume, close FROM mem)
  ON ret_lag1, realised_var_now, volume, quote_volume, close INTO NAME feature VALUE value),
qs AS (SELECT fold, feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi,
  quantile_cont(value, 0.5) AS median FROM lg WHERE split = 'train' GROUP BY ALL),
ms AS (SELECT lg.fold, lg.feature, avg(least(greatest(value, lo), hi)) AS mean, stddev_pop(least(greatest(value, lo), hi)) AS sd
  FROM lg JOIN qs USING (fold, feature) WHERE split = 'train' GROUP BY ALL),
sc AS (SELECT fold, feature, lo, hi, median, mean, CASE WHEN sd > 0 THEN sd ELSE 1 END AS sd FROM qs JOIN ms USING (fold, feature))"""


@query(
    "scaler_fit",
    q.keyed(_STATS, {c: c for c in ("lo", "hi", "median", "mean", "sd")}, "sc", keys="fold, feature"),
)
def scaler_fit(spark, sf):
    return rounded(scaling.fit_scaler(cut_lineage(member(spark, sf, "dir_1d")), SCALED))


def _scaled(c):
    return f"(coalesce(least(greatest({c}, {c}_s.lo), {c}_s.hi), {c}_s.median) - {c}_s.mean) / {c}_s.sd"


_JOINS = " ".join(
    f"JOIN sc AS {c}_s ON {c}_s.fold = mem.fold AND {c}_s.feature = '{c}'" for c in SCALED
)


@query(
    "scaler_transform",
    q.keyed(
        _STATS, {c: _scaled(c) for c in SCALED}, f"mem {_JOINS}",
        keys="mem.fold, mem.split, mem.asset, mem.date",
    ),
)
def scaler_transform(spark, sf):
    m = cut_lineage(member(spark, sf, "dir_1d"))
    out = scaling.transform(m, scaling.fit_scaler(m, SCALED), SCALED)
    return rounded(out.select("fold", "split", "asset", "date", *SCALED))


# -- baselines --------------------------------------------------------------------

_PK = "asset, date, model, fold"


@query("baselines_direction", q.keyed(e.direction(), {c: c for c in ("pred", "proba", "y_true")}, "pr", keys=_PK))
def baselines_direction(spark, sf):
    p = predictions(spark, sf, "dir_1d")
    return rounded(p.select("asset", "date", "model", "fold", "pred", "proba", "y_true"))


@query("baselines_return", q.keyed(e.returns(), {c: c for c in ("pred", "y_true")}, "pr", keys=_PK))
def baselines_return(spark, sf):
    p = predictions(spark, sf, "ret_1d")
    return rounded(p.select("asset", "date", "model", "fold", "pred", "y_true"))


@query("baselines_volatility", q.keyed(e.volatility(), {c: c for c in ("pred", "y_true")}, "pr", keys=_PK))
def baselines_volatility(spark, sf):
    p = predictions(spark, sf, "vol_1d")
    return rounded(p.select("asset", "date", "model", "fold", "pred", "y_true"))


@query(
    "seed_average",
    q.keyed(e.seeded() + ", sa AS (SELECT asset, date, model, avg(proba) AS signal, max(y_true) AS y_true FROM ps GROUP BY ALL)",
            {"signal": "signal", "y_true": "y_true"}, "sa", keys="asset, date, model"),
)
def seed_average(spark, sf):
    return rounded(compare.seed_averaged(seeded(spark, sf), "proba"))


# -- metrics ----------------------------------------------------------------------


@query(
    "classification_metrics",
    q.keyed(e.seeded() + e.class_metrics("ps", "model, fold, seed"), {c: c for c in e.CLASS_COLS}, "cm",
            keys="model, fold, seed, n_obs"),
)
def classification_metrics(spark, sf):
    return rounded(metrics.classification(seeded(spark, sf), ["model", "fold", "seed"]))


_REG = """, rg AS (SELECT model, fold, count(*) AS n_obs, sqrt(avg(pow(y_true - pred, 2))) AS rmse,
  avg(abs(y_true - pred)) AS mae, 1 - sum(pow(y_true - pred, 2)) / sum(pow(y_true, 2)) AS r2_oos FROM pr GROUP BY ALL)"""


@query(
    "regression_metrics",
    q.keyed(e.returns() + _REG, {c: c for c in ("rmse", "mae", "r2_oos")}, "rg", keys="model, fold, n_obs"),
)
def regression_metrics(spark, sf):
    return rounded(metrics.regression(predictions(spark, sf, "ret_1d"), ["model", "fold"]))


VOL_COLS = ("rmse", "mae", "qlike", "rmse_log", "mae_log", "mz_alpha", "mz_beta", "mz_r2", "mz_joint_p")


def vol_metrics_sql(by):
    return f""",
vx AS (SELECT *, exp(y_true) AS y, exp(pred) AS f FROM pr),
vg AS (SELECT {by}, count(*) AS n_obs, sqrt(avg(pow(y - f, 2))) AS rmse, avg(abs(y - f)) AS mae,
  avg(y / f - ln(y / f) - 1) AS qlike, sqrt(avg(pow(y_true - pred, 2))) AS rmse_log, avg(abs(y_true - pred)) AS mae_log,
  avg(y) AS my, avg(f) AS mf, var_pop(f) AS vf, var_pop(y) AS vy, covar_pop(y, f) AS c FROM vx GROUP BY {by}),
vk AS (SELECT *, n_obs * (1 + vf + mf * mf) AS tr, pow(n_obs, 2) * vf AS det FROM vg),
vu AS (SELECT * REPLACE (CASE WHEN n_obs >= 3 AND vf > 0
   AND pow((tr + sqrt(greatest(tr * tr - 4 * det, 0))) / 2, 2) <= 1e12 * det THEN vf END AS vf) FROM vk),
vh AS (SELECT *, c / vf AS mz_beta, my - c / vf * mf AS mz_alpha, 1 - (vy - c / vf * c) / vy AS mz_r2,
  n_obs * (vy - c / vf * c) / (n_obs - 2) AS s2 FROM vu),
vm AS (SELECT *, pow(1 + 2 * (n_obs * (pow(mz_alpha + (mz_beta - 1) * mf, 2) + pow(mz_beta - 1, 2) * vf) / (2 * s2))
  / (n_obs - 2), -(n_obs - 2) / 2.0) AS mz_joint_p FROM vh)"""


@query(
    "volatility_metrics",
    q.keyed(e.volatility() + vol_metrics_sql("model, fold"), {c: c for c in VOL_COLS}, "vm", 4, keys="model, fold, n_obs"),
)
def volatility_metrics(spark, sf):
    return rounded(metrics.volatility(predictions(spark, sf, "vol_1d"), ["model", "fold"]), 4)


_SUMMARY = ("directional_accuracy", "brier_score")


@query(
    "summarise_folds",
    "WITH " + e.seeded() + e.class_metrics("ps", "model, fold, seed") + " SELECT model, " + ", ".join(
        f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(min({c}), 6) AS {c}_min, "
        f"round(max({c}), 6) AS {c}_max, count({c}) AS {c}_count" for c in _SUMMARY) + " FROM cm GROUP BY model",
)
def summarise_folds(spark, sf):
    res = metrics.classification(seeded(spark, sf), ["model", "fold", "seed"])
    return rounded(metrics.summarise_folds(res, _SUMMARY))


# -- comparison tables --------------------------------------------------------------

_PAIRS = """,
av AS (SELECT asset, date, model, avg({col}) AS s, max(y_true) AS y FROM {src} GROUP BY ALL),
pairs AS (SELECT a.model, a.asset, a.date, {f}(a.y) AS y, {f}(a.s) AS a, {f}(b.s) AS b FROM av a JOIN av b
  ON a.asset = b.asset AND a.date = b.date AND b.model = '{base}' WHERE a.model <> '{base}')"""
_DM = {"dm_statistic": "stat", "mean_loss_diff": "md"}
DIR_PAIRS = e.seeded() + _PAIRS.format(col="proba", src="ps", f="", base="zero")
VOL_PAIRS = e.volatility() + _PAIRS.format(col="pred", src="pr", f="exp", base="vol_ewma")


@query(
    "dm_direction",
    q.keyed(DIR_PAIRS + e.dm_sql("model", "pairs", "squared"), _DM, "dm", keys=f"model, {e.DM_BETTER} AS better, n_obs"),
)
def dm_direction(spark, sf):
    t = compare.dm_table(seeded(spark, sf), "zero", "squared", "proba", p_values=False)
    return rounded(t.select("model", "better", "n_obs", "dm_statistic", "mean_loss_diff"))


@query(
    "dm_volatility",
    q.keyed(VOL_PAIRS + e.dm_sql("model", "pairs", "qlike"), _DM, "dm", keys=f"model, {e.DM_BETTER} AS better, n_obs"),
)
def dm_volatility(spark, sf):
    t = compare.dm_table(predictions(spark, sf, "vol_1d"), "vol_ewma", "qlike", p_values=False)
    return rounded(t.select("model", "better", "n_obs", "dm_statistic", "mean_loss_diff"))


@query(
    "dm_per_asset",
    q.keyed(VOL_PAIRS + e.dm_sql("model, asset", "pairs", "qlike"), _DM, "dm",
            keys=f"model, asset, {e.DM_BETTER} AS better, n_obs"),
)
def dm_per_asset(spark, sf):
    t = compare.dm_table(predictions(spark, sf, "vol_1d"), "vol_ewma", "qlike", per_asset=True, p_values=False)
    return rounded(t.select("model", "asset", "better", "n_obs", "dm_statistic", "mean_loss_diff"))


@query(
    "dm_horizon_3",
    "WITH " + VOL_PAIRS + """,
d AS (SELECT *, (y / a - ln(y / a) - 1) - (y / b - ln(y / b) - 1) AS d FROM pairs),
dc AS (SELECT *, d - avg(d) OVER (PARTITION BY model) AS c FROM d),
dl AS (SELECT *, coalesce(lag(c, 1) OVER (PARTITION BY model ORDER BY asset, date), 0)
  + coalesce(lag(c, 2) OVER (PARTITION BY model ORDER BY asset, date), 0) AS l FROM dc),
g AS (SELECT model, count(*) AS n, avg(d) AS md, var_pop(d) + 2 * sum(c * l) / count(*) AS lr FROM dl GROUP BY model)
SELECT model, n AS n_obs, round(CASE WHEN lr > 0 THEN md / sqrt(lr / n) * sqrt((n + 1 - 6 + 6.0 / n) / n) END, 6) AS dm_statistic FROM g""",
)
def dm_horizon_3(spark, sf):
    pairs = compare.against_baseline(predictions(spark, sf, "vol_1d"), "pred", "vol_ewma", True)
    t = compare.diebold_mariano(cut_lineage(pairs), ["model"], loss="qlike", horizon=3, p_values=False)
    return rounded(t.select("model", "n_obs", "dm_statistic"))


@query("dm_p_values")
def dm_p_values(spark, sf):
    """The full test table with Student-t tail probabilities."""
    return rounded(compare.dm_table(predictions(spark, sf, "vol_1d"), "vol_ewma", "qlike"))


_WITH_ALL = """,
pa AS (SELECT asset, date, pred, proba, model, fold, y_true FROM pr UNION ALL SELECT 'all', date, pred, proba, model, fold, y_true FROM pr),
nf AS (SELECT model, asset, count(DISTINCT fold) AS n_folds FROM pa GROUP BY ALL)"""


@query(
    "per_asset_results",
    q.keyed(e.direction() + _WITH_ALL + e.class_metrics("pa", "model, asset") +
            ", x AS (SELECT cm.*, n_folds FROM cm JOIN nf USING (model, asset))",
            {c: c for c in e.CLASS_COLS}, "x", keys="model, asset, n_folds, n_obs"),
)
def per_asset_results(spark, sf):
    return rounded(compare.per_asset_results(predictions(spark, sf, "dir_1d"), "dir_1d"))


@query(
    "per_asset_volatility",
    q.keyed(e.volatility() + """,
pa AS (SELECT asset, pred, model, fold, y_true FROM pr UNION ALL SELECT 'all', pred, model, fold, y_true FROM pr),
nf AS (SELECT model, asset, count(DISTINCT fold) AS n_folds FROM pa GROUP BY ALL)""" +
            vol_metrics_sql("model, asset").replace("FROM pr)", "FROM pa)") +
            ", x AS (SELECT vm.*, n_folds FROM vm JOIN nf USING (model, asset))",
            {c: c for c in VOL_COLS}, "x", 4, keys="model, asset, n_folds, n_obs"),
)
def per_asset_volatility(spark, sf):
    return rounded(compare.per_asset_results(predictions(spark, sf, "vol_1d"), "vol_1d"), 4)


RESULTS = "WITH " + e.seeded() + e.class_metrics("ps", "model, fold, seed")


def results(spark, sf):
    return metrics.classification(seeded(spark, sf), ["model", "fold", "seed"])


@query(
    "fold_table",
    RESULTS + """ SELECT model, round(avg(directional_accuracy), 4) AS directional_accuracy_mean,
 round(stddev_samp(directional_accuracy), 4) AS directional_accuracy_std, round(avg(roc_auc), 4) AS roc_auc_mean,
 round(stddev_samp(roc_auc), 4) AS roc_auc_std, count(DISTINCT fold) AS n_folds FROM cm GROUP BY model""",
)
def fold_table(spark, sf):
    return compare.fold_table(results(spark, sf), ["directional_accuracy", "roc_auc"])


@query(
    "edge_over_baseline",
    RESULTS + """, p AS (SELECT fold, model, avg(directional_accuracy) AS v FROM cm GROUP BY ALL),
 e AS (SELECT p.model, p.v - b.v AS e FROM p JOIN p b ON p.fold = b.fold AND b.model = 'persistence' WHERE p.model <> 'persistence')
 SELECT model, round(avg(e), 4) + 0.0 AS mean_edge, round(stddev_samp(e), 4) AS std_edge, count(*) FILTER (WHERE e > 0) AS folds_ahead,
 count(e) AS n_folds, round(count(*) FILTER (WHERE e > 0)::DOUBLE / count(e), 3) AS win_rate FROM e GROUP BY model""",
)
def edge_over_baseline(spark, sf):
    return compare.edge_over_baseline(results(spark, sf), "directional_accuracy", "persistence")


@query(
    "seed_spread",
    RESULTS + """, p AS (SELECT model, fold, avg(directional_accuracy) AS m, stddev_samp(directional_accuracy) AS s FROM cm GROUP BY ALL)
 SELECT model, round(avg(m), 4) AS mean_across_seeds, round(avg(s), 4) AS mean_seed_std FROM p GROUP BY model""",
)
def seed_spread(spark, sf):
    return compare.seed_spread(results(spark, sf), "directional_accuracy")


REGIMES = f""",
tg AS (SELECT asset, date, close / lag(close, 90) OVER ({q.W}) - 1 AS t FROM bars),
rgm AS (SELECT asset, date, CASE WHEN t IS NULL THEN 'unknown' WHEN t > 0.10 THEN 'bull' WHEN t < -0.10 THEN 'bear' ELSE 'sideways' END AS regime FROM tg)"""


@query("regimes", f"WITH {q.BARS}{REGIMES} SELECT asset, date, regime FROM rgm")
def regimes(spark, sf):
    return compare.classify_regime(ds.panel(spark, sf))


_HIT = "CASE WHEN (CASE WHEN coalesce(proba, pred) >= 0.5 THEN 1.0 ELSE 0.0 END) = y_true THEN 1.0 ELSE 0.0 END"


@query(
    "regime_breakdown",
    "WITH " + e.direction() + REGIMES + f""",
 g AS (SELECT model, regime, avg({_HIT}) AS a, avg(y_true) AS b, count(*) AS n FROM pr LEFT JOIN rgm USING (asset, date) GROUP BY ALL)
 SELECT model, regime, round(a, 4) AS accuracy, round(b, 4) AS base_rate, n, round(a - greatest(b, 1 - b), 4) + 0.0 AS edge_over_base FROM g""",
)
def regime_breakdown(spark, sf):
    return compare.regime_breakdown(predictions(spark, sf, "dir_1d"), compare.classify_regime(ds.panel(spark, sf)))


@query(
    "per_asset_breakdown",
    "WITH " + e.direction() + f" SELECT model, asset, round(avg({_HIT}), 4) AS accuracy, round(avg(y_true), 4) AS base_rate, count(*) AS n FROM pr GROUP BY ALL",
)
def per_asset_breakdown(spark, sf):
    return compare.per_asset_breakdown(predictions(spark, sf, "dir_1d"))


@query(
    "scope_comparison",
    "WITH " + e.direction() + """,
 sp AS (SELECT model AS family, asset, date, proba AS b, y_true AS y FROM pr WHERE model = 'persistence'),
 so AS (SELECT asset, date, proba AS a FROM pr WHERE model = 'historical_mean'),
 sj AS (SELECT family, sp.asset, sp.date, a, b, y FROM sp JOIN so ON sp.asset = so.asset AND sp.date = so.date),
 pairs AS (SELECT * FROM sj UNION ALL SELECT family, 'all', date, a, b, y FROM sj),
 acc AS (SELECT family, asset, round(avg(CASE WHEN (b >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy_pooled,
   round(avg(CASE WHEN (a >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 4) AS accuracy_per_asset FROM pairs GROUP BY ALL)"""
    + e.dm_sql("family, asset", "pairs", "squared")
    + """ SELECT family, asset, round(stat, 6) AS dm_statistic,
   CASE WHEN stat IS NULL OR md = 0 THEN 'tie' WHEN md < 0 THEN 'per_asset' ELSE 'pooled' END AS better, n_obs,
   accuracy_pooled, accuracy_per_asset FROM dm JOIN acc USING (family, asset)""",
)
def scope_comparison(spark, sf):
    """Two baselines stand in for the pooled and per-asset arm of one family."""
    p = predictions(spark, sf, "dir_1d").filter(F.col("model").isin("persistence", "historical_mean"))
    name = F.when(F.col("model") == "historical_mean", "persistence_per_asset").otherwise(F.col("model"))
    return rounded(compare.scope_comparison(p.withColumn("model", name), p_values=False))


@query(
    "error_breakdown",
    q.keyed(e.returns() + ", g AS (SELECT model, asset, sqrt(avg(pow(y_true - pred, 2))) AS rmse, avg(abs(y_true - pred)) AS mae, count(*) AS n FROM pr GROUP BY ALL)",
            {"rmse": "rmse", "mae": "mae"}, "g", keys="model, asset, n"),
)
def error_breakdown(spark, sf):
    return rounded(compare.error_breakdown(predictions(spark, sf, "ret_1d"), ["model", "asset"]))


_MODELS = baselines.BASELINES["dir_1d"]


@query(
    "accuracy_over_time",
    RESULTS + " SELECT fold, " + ", ".join(
        f"round(avg(directional_accuracy) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in _MODELS) + " FROM cm GROUP BY fold",
)
def accuracy_over_time(spark, sf):
    return rounded(compare.accuracy_over_time(results(spark, sf), "directional_accuracy", _MODELS))


# A model-free importance: absolute training correlation of a column with the target.
_IMP = e.membership("ret_1d") + ", im AS (" + " UNION ALL ".join(
    f"SELECT 'corr' AS model, '{c}' AS feature, fold, abs(corr({c}, ret_1d)) AS gain FROM mem WHERE split = 'train' GROUP BY fold"
    for c in SCALED) + ")"


def importances(spark, sf):
    train = member(spark, sf, "ret_1d").filter("split = 'train'")
    return scaling.unpivot(
        train.groupBy("fold").agg(*[F.abs(moments.corr(c, "ret_1d")).alias(c) for c in SCALED]), ["fold"], SCALED
    ).select(F.lit("corr").alias("model"), "feature", "fold", F.col("value").alias("gain"))


@query(
    "importance_top",
    "WITH " + _IMP + """ SELECT model, feature, round(avg(gain), 6) AS mean_gain, round(stddev_samp(gain), 6) AS std_gain,
 count(DISTINCT fold) AS n_folds, CAST(row_number() OVER (ORDER BY avg(gain) DESC, feature) AS INTEGER) AS rank FROM im GROUP BY model, feature""",
)
def importance_top(spark, sf):
    return rounded(compare.importance_top(importances(spark, sf)))


@query(
    "importance_rank_stability",
    "WITH " + _IMP + """, rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY gain DESC) AS r FROM im)
 SELECT model, feature, round(avg(gain), 6) AS mean_gain, min(r) AS best_rank, max(r) AS worst_rank,
 round(stddev_samp(r), 6) AS rank_std, max(r) - min(r) AS rank_range FROM rk GROUP BY model, feature""",
)
def importance_rank_stability(spark, sf):
    return rounded(compare.rank_stability(importances(spark, sf)))


# -- backtest -----------------------------------------------------------------------


def traded(spark, sf):
    """Positions of every direction baseline with realised forward returns."""
    rows = cut_lineage(add_targets(add_meta(ds.panel(spark, sf))))
    usable = drop_warmup(rows, ds.WARMUP, "dir_1d")
    m = folds.assign_splits(usable, cut_lineage(folds.walk_forward_folds(usable, ds.EXPANDING)))
    p = baselines.return_baselines(m, "dir_1d").drop("seed")
    p = p.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    p = p.withColumn("proba", F.col("proba") + (2 * F.col("seed") - 1) * 0.01)
    return backtest.with_forward_returns(backtest.positions_for(p), rows)


@query("positions", q.keyed(e.positions(), {"position": "position", "forward_return": "forward_return"}, "po", keys="model, asset, date"))
def positions(spark, sf):
    return rounded(traded(spark, sf).select("model", "asset", "date", "position", "forward_return"))


@query(
    "backtest_book",
    q.keyed(e.positions() + e.book("po", "model"),
            {"position": "p", "weight": "wt", "turnover": "turn", "weight_turnover": "wturn", "gross": "p * forward_return",
             "cost": "turn * 0.001", "net": "p * forward_return - turn * 0.001"}, "bk", keys="model, asset, date, CAST(na AS BIGINT) AS n_active"),
)
def backtest_book(spark, sf):
    b = backtest.book(traded(spark, sf), ["model"], backtest.CostModel())
    return rounded(b.select("model", "asset", "date", "n_active", "position", "weight", "turnover", "weight_turnover", "gross", "cost", "net"))


@query(
    "equity_curves",
    q.keyed(e.positions() + e.book("po", "model") + e.curve("model", "[0.0, 5.0, 20.0]", "cv", "bkd"),
            {"gross_return": "gross", "turnover": "turnover", "net_return": "net", "equity": "equity"}, "cv",
            keys="model, CAST(cost_bps AS DOUBLE) AS cost_bps, date, CAST(na AS BIGINT) AS n_active"),
)
def equity_curves(spark, sf):
    c = backtest.curves(traded(spark, sf), ["model"])
    return rounded(c.select("model", "cost_bps", "date", "n_active", "gross_return", "turnover", "net_return", "equity"))


@query("cost_sweep", e.sweep("model"))
def cost_sweep(spark, sf):
    return rounded(backtest.cost_sweep(traded(spark, sf), ["model"]))


@query("per_asset_sweep", e.sweep("model, asset"))
def per_asset_sweep(spark, sf):
    return rounded(backtest.per_asset_sweep(traded(spark, sf)))


@query(
    "buy_and_hold",
    "WITH " + q.TARGETS + ", po AS (SELECT 'panel' AS model, asset, date, fwd_ret_simple AS forward_return FROM m)"
    + e.book("po", "model", "1.0::DOUBLE", "bh") + e.curve("model", "[0.0]", "hv", "bhd") + e.stats("model", "hv", "sh")
    + " " + e.stat_select("model", "sh", "buy_and_hold", "NULL"),
)
def buy_and_hold(spark, sf):
    t = add_targets(ds.panel(spark, sf))
    held = t.select(F.lit("panel").alias("model"), "asset", "date", F.col("fwd_ret_simple").alias("forward_return"))
    curve = backtest.buy_and_hold(held, ["model"])
    stats = backtest.compute_stats(curve, ["model", "cost_bps"])
    return rounded(stats.withColumn("strategy", F.lit("buy_and_hold")))
