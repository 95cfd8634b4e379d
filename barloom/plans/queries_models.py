"""Queries over learned and recursive forecasters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import positive_ln, rounded
from barloom.functions.series import Series
from barloom.operators import baselines, blocks, boosting, folds, lagged, linear, metrics, sequences, timeseries, variance_blocks
from barloom.operators.matrix import drop_warmup, feature_columns
from barloom.operators.targets import add_meta, add_targets
from barloom.plans import datasets as ds
from barloom.plans import evaltext as e
from barloom.plans import experiment, study
from barloom.plans import sqltext as q
from barloom.plans.queries_eval import member
from barloom.plans.queries_features import full_matrix
from barloom.plans.registry import query
from barloom.plans.session import cut_lineage, remembered



def matrix(spark, sf, target):
    """Every feature of every family with targets and meta, after warmup; and the feature names."""
    m = drop_warmup(full_matrix(spark, sf), ds.WARMUP, target)
    names = feature_columns(m)
    keep = ["asset", "date", "ret_1d", "dir_1d", "vol_1d", "ret_lag1", "realised_var_now"]
    return cut_lineage(m.select(*dict.fromkeys([*keep, *names]))), names


def designed(spark, sf, target, plan=ds.EXPANDING):
    """Scaled rows (fold, split, asset, date, x, y) of all folds and features, their names, and the unscaled members; once per session."""

    def build():
        m, names = matrix(spark, sf, target)
        members = cut_lineage(folds.assign_splits(m, folds.walk_forward_folds(m, plan)))
        return cut_lineage(linear.design(experiment.scale_members(members, names), names, target)), names, members

    return remembered(spark, ("design", sf, target, plan), build)


_ALPHA = ", ".join(str(a) for a in linear.ALPHAS)
RIDGE1 = e.membership("ret_1d") + f""",
rb AS (SELECT fold, count(*) AS n, avg(ret_lag1) AS mx, avg(ret_1d) AS my, sum(pow(ret_lag1, 2)) - count(*) * pow(avg(ret_lag1), 2) AS sxx,
  sum(ret_lag1 * ret_1d) - count(*) * avg(ret_lag1) * avg(ret_1d) AS sxy FROM mem WHERE split = 'train' GROUP BY 1),
rf AS (SELECT fold, a, n, sxy / (sxx + a) AS w, my - sxy / (sxx + a) * mx AS c FROM rb, (SELECT unnest([{_ALPHA}]) AS a) t),
rv AS (SELECT rf.fold, a, avg(pow(c + w * ret_lag1 - ret_1d, 2)) AS mse FROM rf JOIN mem ON mem.fold = rf.fold AND split = 'val' GROUP BY 1, 2),
rp AS (SELECT fold, arg_min(a, mse) AS a FROM rv GROUP BY 1),
x AS (SELECT rf.fold, rf.a, n, w, c FROM rf JOIN rp ON rp.fold = rf.fold AND rp.a = rf.a)"""


@query(
    "ridge_one_feature",
    q.keyed(RIDGE1, {"intercept": "c", "coef": "w"}, "x", keys="fold, CAST(a AS DOUBLE) AS alpha, n AS n_train"),
)
def ridge_one_feature(spark, sf):
    rows = linear.design(member(spark, sf, "ret_1d"), ["ret_lag1"], "ret_1d")
    c = linear.fit_ridge_pooled(rows)
    return rounded(c.select("fold", "alpha", "n_train", "intercept", F.get("coef", F.lit(0)).alias("coef")))


@query("ridge_coefficients")
def ridge_coefficients(spark, sf):
    rows, names, _ = designed(spark, sf, "ret_1d")
    both = linear.fit_ridge_pooled(rows).unionByName(linear.fit_ridge_per_asset(rows))
    return rounded(linear.coefficients(both, names, "ridge"))


@query("ridge_importance")
def ridge_importance(spark, sf):
    rows, names, _ = designed(spark, sf, "ret_1d")
    return rounded(linear.importance(linear.fit_ridge_pooled(rows), names, "ridge"))


@query("logistic_direction")
def logistic_direction(spark, sf):
    """Pooled and per-asset logistic probabilities over all folds and features."""
    rows, names, members = designed(spark, sf, "dir_1d")
    return rounded(study.linear_family(study.Data(members, rows, names, "dir_1d"))[0])


def boosted(spark, sf):
    """Five seeds of boosted trees in both scopes over all folds and features; once per session."""

    def build():
        rows, names, _ = designed(spark, sf, "dir_1d")
        return boosting.fit_predict(rows, names, "boosted_trees", "dir_1d", study.SEEDS)

    return remembered(spark, ("boosted", sf), build)


@query("boosted_trees_direction")
def boosted_trees_direction(spark, sf):
    return rounded(boosted(spark, sf)[0])


@query("boosted_trees_gains")
def boosted_trees_gains(spark, sf):
    return rounded(boosted(spark, sf)[1])


@query("arma_direction")
def arma_direction(spark, sf):
    return rounded(timeseries.arma_predictions(member(spark, sf, "dir_1d"), "dir_1d"))


def _variance(variant, mode):
    def run(spark, sf):
        return rounded(timeseries.variance_predictions(cut_lineage(member(spark, sf, "vol_1d")), variant, mode))

    return run


query("garch_volatility")(_variance("garch11", "level"))
query("garch_volatility_mz")(_variance("garch11", "mz"))
query("egarch_volatility")(_variance("egarch11", "level"))


@query("intraday_garch")
def intraday_garch(spark, sf):
    """GARCH variances of hourly bars, from block to block: two thirds of the span train, the rest is forecast."""
    numbered = blocks.number_rows(ds.event_bars(spark, sf).filter("close > 0"), ("asset",), ("date",), F.to_date("date"))

    def returns(df, keys):
        s = Series(keys, ("_pos",))
        return df.withColumn("ret_lag1", F.ln("close") - s.lag(F.ln("close")))

    rows = cut_lineage(blocks.on_blocks(numbered, returns, halo=1).select("asset", "date", F.col("_pos") - 1, "ret_lag1"))
    rows = rows.toDF("asset", "date", "_pos", "ret_lag1").filter("ret_lag1 IS NOT NULL")
    at = F.col("date").cast("double")
    ends = rows.agg(F.min(at), F.max(at)).head()
    limit = ends[0] + (ends[1] - ends[0]) * 2 / 3 if ends[0] is not None else 0.0
    split = F.when(at < limit, "train").otherwise("test")
    out = variance_blocks.variance_paths(rows.withColumn("split", split), ("asset",))
    return rounded(out.withColumn("date", F.col("date").cast("timestamp_ntz")))


@query("garch_metrics")
def garch_metrics(spark, sf):
    """Pooled volatility scores of both recursions next to the baselines."""
    m = cut_lineage(member(spark, sf, "vol_1d"))
    frames = [timeseries.variance_predictions(m, v) for v in ("garch11", "egarch11")]
    allp = reduce(DataFrame.unionByName, [*frames, baselines.baselines_for(m, "vol_1d")])
    return rounded(metrics.volatility(allp, ["model"]), 4)


CAL = e.membership("vol_1d") + f""",
mv AS (SELECT asset, date, ln(pow({q.roll("stddev_samp", "r1", 21)}, 2)) AS x FROM r),
t AS (SELECT fold, mem.asset, x, ln(CASE WHEN realised_var_now > 0 THEN realised_var_now END) AS y FROM mem
  JOIN mv ON mv.asset = mem.asset AND mv.date = mem.date WHERE split = 'train'),
g AS (SELECT fold, asset, count(*) AS n, avg(y - x) AS gap, regr_slope(y, x) AS s, regr_intercept(y, x) AS c FROM t WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
k AS (SELECT fold, asset, CASE WHEN n >= 100 AND s > 0.05 AND s < 5 THEN c WHEN n >= 100 THEN gap ELSE 0 END AS i,
  CASE WHEN n >= 100 AND s > 0.05 AND s < 5 THEN s ELSE 1 END AS s FROM g)"""


@query("variance_calibration", q.keyed(CAL, {"intercept": "i", "slope": "s"}, "k", keys="fold, asset"))
def variance_calibration(spark, sf):
    """Calibration of a rolling variance, which SQL can reproduce."""
    sd = Series().std("ret_lag1", 21)
    p = add_targets(add_meta(ds.frozen_panel(spark, sf))).withColumn("_x", sd)
    rows = cut_lineage(drop_warmup(p.withColumn("_x", positive_ln(F.col("_x") * F.col("_x"))), ds.WARMUP, "vol_1d"))
    m = folds.assign_splits(rows, folds.walk_forward_folds(rows, ds.EXPANDING))
    return rounded(timeseries.calibrate(m.filter("split = 'train'"), F.col("_x"), positive_ln("realised_var_now"), "mz"))


@query(
    "fit_scopes",
    f"WITH {e.membership('ret_1d')} SELECT fold, asset, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'train') >= 500 AS fitted FROM mem GROUP BY 1, 2",
)
def fit_scopes(spark, sf):
    return linear.skipped_scopes(linear.design(member(spark, sf, "ret_1d"), ["ret_lag1"], "ret_1d"))


@query(
    "target_scale",
    q.keyed(e.membership("vol_1d") + ", g AS (SELECT fold, avg(vol_1d) AS m, stddev_pop(vol_1d) AS s FROM mem WHERE split = 'train' GROUP BY 1)",
            {"y_mean": "m", "y_sd": "s"}, "g", keys="fold"),
)
def target_scale(spark, sf):
    return rounded(linear.target_scale(member(spark, sf, "vol_1d"), "vol_1d"))


SEQ = q.RET + f""",
h AS (SELECT asset, date, list([coalesce(r1, 0), volume]) OVER {q.frame(30)} AS h FROM r),
s AS (SELECT asset, date, list_concat(list_transform(range(30 - len(h)), lambda i: [0.0::DOUBLE, 0.0::DOUBLE]), h) AS w FROM h)"""


@query(
    "sequence_windows",
    q.keyed(SEQ, {"oldest": "w[1][2]", "newest": "w[30][2]", "total": "list_sum(list_transform(w, lambda r: r[1] + r[2]))"}, "s", 4,
            keys="asset, date, len(w)::INTEGER AS length"),
)
def sequence_windows(spark, sf):
    df = sequences.sequence_windows(add_meta(ds.panel(spark, sf)), ["ret_lag1", "volume"], 30)
    total = F.aggregate("window", F.lit(0.0), lambda acc, r: acc + r[0] + r[1])
    return rounded(
        df.select("asset", "date", F.size("window").alias("length"), F.col("window")[0][1].alias("oldest"),
                  F.col("window")[29][1].alias("newest"), total.alias("total")), 4)


@query(
    "window_decomposition",
    q.keyed(SEQ + """,
v AS (SELECT asset, date, list_transform(w, lambda r: r[2]) AS v FROM s),
t AS (SELECT asset, date, v, list_transform(range(30), lambda i: list_avg(list_transform(range(-3, 4), lambda j: v[1 + greatest(0, least(29, i + j))]))) AS t FROM v)""",
            {"trend_first": "t[1]", "trend_mid": "t[15]", "trend_last": "t[30]", "seasonal_last": "v[30] - t[30]"}, "t"),
)
def window_decomposition(spark, sf):
    df = sequences.sequence_windows(ds.panel(spark, sf), ["volume"], 30)
    df = sequences.decompose(df, 1, 30)
    at = lambda c, i, n: F.col(c)[i].alias(n)
    return rounded(df.select("asset", "date", at("trend", 0, "trend_first"), at("trend", 14, "trend_mid"),
                             at("trend", 29, "trend_last"), at("seasonal", 29, "seasonal_last")))


@query(
    "asset_codes",
    f"WITH {e.membership('ret_1d')}, c AS (SELECT DISTINCT fold, asset FROM mem WHERE split = 'train') "
    "SELECT fold, asset, CAST(row_number() OVER (PARTITION BY fold ORDER BY asset) - 1 AS INTEGER) AS code FROM c",
)
def asset_codes(spark, sf):
    return sequences.asset_codes(member(spark, sf, "ret_1d"))


@query("decomposed_linear")
def decomposed_linear(spark, sf):
    """Linear forecaster on the trend and seasonal parts of each window of 30 rows of all features, in both scopes."""
    rows, _, _ = designed(spark, sf, "ret_1d")
    return rounded(lagged.predict(rows, lagged.fit(rows), "dlinear", "ret_1d"))


def studied(spark, sf, target="ret_1d"):
    """The tables of one study of every family in both scopes; once per session."""

    def build():
        rows, names, members = designed(spark, sf, target)
        found = experiment.run_experiment(spark, members, rows, names, target)
        return found["ledger"], found

    return remembered(spark, ("study", sf, target), build)[1]


@query("experiment_results")
def experiment_results(spark, sf):
    """Per-fold scores of baselines, ridge, boosted trees, the window model and ARMA in both scopes."""
    return rounded(studied(spark, sf)["results"])


@query("experiment_ledger")
def experiment_ledger(spark, sf):
    """The fits of the study: finished, skipped for want of rows, or failed."""
    return studied(spark, sf)["ledger"].select("model", "fold", "seed", "status", "n_rows")


@query("study_scope_comparison")
def study_scope_comparison(spark, sf):
    """Pooled against per-asset arms of ridge, boosted trees and the window model."""
    return rounded(studied(spark, sf)["scope"])


@query("study_importance_top")
def study_importance_top(spark, sf):
    """Features by the gains of boosted trees and the coefficients of ridge."""
    return rounded(studied(spark, sf)["importance_top"])


@query("study_importance_rank_stability")
def study_importance_rank_stability(spark, sf):
    return rounded(studied(spark, sf)["importance_rank_stability"])
