"""Comparison of forecasters: Diebold-Mariano tests, breakdowns and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import finite
from barloom.functions.normal import normal_cdf
from barloom.functions.series import Series
from barloom.functions.tails import t_p_value
from barloom.operators import blocks, metrics

LOSSES = ("squared", "absolute", "qlike")
SCOPE_SUFFIX = "_per_asset"
# Metrics where smaller is better; tables sort them ascending.
ERROR_METRICS = frozenset({"rmse", "mae", "qlike", "rmse_log", "mae_log", "brier_score"})


def default_loss(target: str) -> str:
    return "qlike" if target == "vol_1d" else "squared"


def default_baseline(target: str) -> str:
    return "vol_ewma" if target == "vol_1d" else "zero"


def seed_averaged(predictions: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """Mean forecast per (asset, date, model) over seeds, long form.

    ``keep_empty`` keeps keys whose every forecast is missing, with a NULL mean.
    """
    rows = predictions if keep_empty else predictions.filter(F.col(column).isNotNull())
    return rows.groupBy("asset", "date", "model").agg(
        F.avg(column).alias("signal"), F.max("y_true").alias("y_true")
    )


def loss_of(y: Column, f: Column, loss: str) -> Column:
    if loss == "squared":
        return (y - f) * (y - f)
    if loss == "absolute":
        return F.abs(y - f)
    if loss == "qlike":
        ratio = F.try_divide(y, f)
        bad = F.raise_error(F.lit("qlike needs strictly positive variances")).cast("double")
        return F.when((y > 0) & (f > 0), ratio - F.ln(ratio) - 1).otherwise(bad)
    raise ValueError(f"unknown loss {loss!r}, expected one of {LOSSES}")


def diebold_mariano(
    pairs: DataFrame,
    by: Sequence[str],
    *,
    y: str = "y",
    a: str = "a",
    b: str = "b",
    loss: str = "squared",
    horizon: int = 1,
    harvey: bool = True,
    p_values: bool = True,
) -> DataFrame:
    """Test of equal expected loss of forecasts ``a`` and ``b``, one row per group.

    A negative statistic means ``a`` has the lower loss.  Horizon 1 needs only grouped
    moments of the loss differential; longer horizons add its autocovariances in
    (asset, date) order, computed on halo blocks so that one large group still spreads.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    by, h = list(by), horizon
    rows = pairs.select(*pairs.columns, *[finite(c).alias(f"_{c}") for c in (y, a, b)])
    rows = rows.filter(" and ".join(f"_{c} is not null" for c in (y, a, b)))
    yy, fa, fb = F.col(f"_{y}"), F.col(f"_{a}"), F.col(f"_{b}")
    rows = rows.withColumn("_d", loss_of(yy, fa, loss) - loss_of(yy, fb, loss))
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.avg("_d").alias("mean_loss_diff"),
        F.var_pop("_d").alias("_g0"),
        F.bool_and(fa == fb).alias("_same"),
    )
    long_run = F.col("_g0")
    if h > 1:
        g = g.join(_autocovariances(rows, g, by, h), by)
        long_run = long_run + 2 * F.col("_gk")
    n = F.col("n_obs").cast("double")
    factor = (n + 1 - 2 * h + h * (h - 1) / n) / n if harvey else F.lit(1.0)
    note = (
        F.when(F.col("n_obs") < 5, "too few observations")
        .when(F.col("_same"), "forecasts are identical")
        .when(~(F.col("_g0") > 0), "loss differential is constant")
        .when(~(F.col("_lr") > 0), "long run variance is not positive")
        .when(~(factor > 0), "small-sample correction undefined")
        .otherwise("")
    )
    ok = F.col("note") == ""
    out = g.withColumn("_lr", long_run).withColumn("note", note)
    stat = F.col("mean_loss_diff") / F.sqrt(F.col("_lr") / n) * F.sqrt(factor)
    out = out.withColumn("dm_statistic", F.when(ok, stat))
    better = F.when(F.col("mean_loss_diff") < 0, "a").when(F.col("mean_loss_diff") > 0, "b")
    cols = [
        *by, "dm_statistic", "mean_loss_diff",
        F.when(ok, F.coalesce(better, F.lit("tie"))).otherwise("tie").alias("better"),
        "n_obs", "note",
    ]
    if p_values:
        t_tail = t_p_value(F.col("dm_statistic"), (F.col("n_obs") - 1).cast("double"))
        tail = t_tail if harvey else 2 * normal_cdf(-F.abs("dm_statistic"))
        cols.insert(len(by) + 1, tail.alias("p_value"))
    return out.select(*cols)


def _autocovariances(rows: DataFrame, moments: DataFrame, by: list[str], h: int) -> DataFrame:
    """Sum of the first ``h - 1`` autocovariances (divisor n) per group."""
    numbered = blocks.number_rows(rows, by, ["asset", "date"], F.col("asset"))
    centred = numbered.join(moments.select(*by, "mean_loss_diff", "n_obs"), by).withColumn(
        "_dc", F.col("_d") - F.col("mean_loss_diff")
    )
    pieces = blocks.with_halo(centred, h - 1)
    s = Series(keys=[*by, "_block"], order=["_pos"])
    lagged = sum((F.coalesce(s.lag("_dc", k), F.lit(0.0)) for k in range(1, h)), F.lit(0.0))
    terms = pieces.withColumn("_t", F.col("_dc") * lagged / F.col("n_obs")).filter("_own")
    return terms.groupBy(*by).agg(F.sum("_t").alias("_gk"))


def against_baseline(predictions: DataFrame, column: str, baseline: str, exponentiate: bool) -> DataFrame:
    """Every model's seed-averaged forecast next to the baseline's on common rows."""
    avg = seed_averaged(predictions, column)
    if exponentiate:
        avg = avg.withColumn("signal", F.exp("signal")).withColumn("y_true", F.exp("y_true"))
    base = avg.filter(F.col("model") == baseline).select("asset", "date", F.col("signal").alias("b"))
    return (
        avg.filter(F.col("model") != baseline)
        .join(base, ["asset", "date"])
        .select("model", "asset", "date", F.col("y_true").alias("y"), F.col("signal").alias("a"), "b")
    )


def dm_table(
    predictions: DataFrame, baseline: str, loss: str, column: str = "pred",
    per_asset: bool = False, p_values: bool = True,
) -> DataFrame:
    """Test of every model against one baseline; empty when the baseline is absent."""
    pairs = against_baseline(predictions, column, baseline, loss == "qlike")
    by = ["model", "asset"] if per_asset else ["model"]
    out = diebold_mariano(pairs, by, loss=loss, p_values=p_values)
    return out.select(
        *by, F.lit(baseline).alias("vs_baseline"), F.lit(loss).alias("loss"),
        *[c for c in out.columns if c not in by],
    )


def with_pooled(df: DataFrame, column: str = "asset") -> DataFrame:
    """Each row once under its own group and once under ``all``."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit("all"))))


def per_asset_results(predictions: DataFrame, target: str) -> DataFrame:
    """Metrics per (model, asset) and pooled; every seed's forecast is a row."""
    rows = with_pooled(predictions)
    by = ["model", "asset"]
    folds = rows.groupBy(*by).agg(F.countDistinct("fold").alias("n_folds"))
    return folds.join(metrics.score(rows, by, target), by)


def fold_table(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and spread across result rows; best model first by the first metric."""
    aggs = [f for c in columns for f in (
        F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_std"))]
    out = results.groupBy("model").agg(*aggs, F.countDistinct("fold").alias("n_folds"))
    first = F.col(f"{columns[0]}_mean")
    return out.orderBy(first.asc() if columns[0] in ERROR_METRICS else first.desc(), "model")


def edge_over_baseline(results: DataFrame, metric: str, baseline: str) -> DataFrame:
    """Within-fold difference of each model to the baseline, summarised."""
    per = results.groupBy("fold", "model").agg(F.avg(metric).alias("_m"))
    base = per.filter(F.col("model") == baseline).select("fold", F.col("_m").alias("_b"))
    edge = per.filter(F.col("model") != baseline).join(F.broadcast(base), "fold")
    edge = edge.withColumn("_e", F.col("_m") - F.col("_b"))
    ahead = F.sum((F.col("_e") > 0).cast("bigint"))
    n = F.count("_e")
    return edge.groupBy("model").agg(
        F.round(F.avg("_e"), 4).alias("mean_edge"),
        F.round(F.stddev_samp("_e"), 4).alias("std_edge"),
        F.coalesce(ahead, F.lit(0)).alias("folds_ahead"),
        n.alias("n_folds"),
        F.round(F.try_divide(ahead, n), 3).alias("win_rate"),
    )


def seed_spread(results: DataFrame, metric: str) -> DataFrame:
    """Average across folds of the seed mean and the seed-to-seed spread."""
    per = results.filter(F.col("seed").isNotNull()).groupBy("model", "fold").agg(
        F.avg(metric).alias("_m"), F.stddev_samp(metric).alias("_s")
    )
    return per.groupBy("model").agg(
        F.round(F.avg("_m"), 4).alias("mean_across_seeds"),
        F.round(F.avg("_s"), 4).alias("mean_seed_std"),
    )


def classify_regime(
    panel: DataFrame, lookback: int = 90, bull: float = 0.10, bear: float = -0.10
) -> DataFrame:
    """Label each row by its trailing simple return."""
    trailing = F.try_divide(F.col("close"), Series().lag("close", lookback)) - 1
    label = (
        F.when(F.col("_t").isNull(), "unknown")
        .when(F.col("_t") > bull, "bull")
        .when(F.col("_t") < bear, "bear")
        .otherwise("sideways")
    )
    return panel.withColumn("_t", trailing).select("asset", "date", label.alias("regime"))


def _hits(predictions: DataFrame) -> DataFrame:
    signal = F.coalesce("proba", "pred")
    return predictions.filter(F.col("y_true").isNotNull()).withColumn(
        "_hit", ((signal >= 0.5).cast("double") == F.col("y_true")).cast("double")
    )


def regime_breakdown(predictions: DataFrame, regimes: DataFrame) -> DataFrame:
    """Accuracy within each regime and its edge over the better constant call."""
    rows = _hits(predictions).join(regimes, ["asset", "date"], "left")
    out = rows.groupBy("model", "regime").agg(
        F.avg("_hit").alias("_a"), F.avg("y_true").alias("_b"), F.count(F.lit(1)).alias("n")
    )
    edge = F.col("_a") - F.greatest(F.col("_b"), 1 - F.col("_b"))
    return out.select(
        "model", "regime", F.round("_a", 4).alias("accuracy"), F.round("_b", 4).alias("base_rate"),
        "n", F.round(edge, 4).alias("edge_over_base"),
    )


def per_asset_breakdown(predictions: DataFrame) -> DataFrame:
    return _hits(predictions).groupBy("model", "asset").agg(
        F.round(F.avg("_hit"), 4).alias("accuracy"),
        F.round(F.avg("y_true"), 4).alias("base_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def scope_comparison(predictions: DataFrame, column: str = "proba", p_values: bool = True) -> DataFrame:
    """Pooled against per-asset fits of the same family on their common rows."""
    avg = seed_averaged(predictions, column)
    own = avg.filter(F.col("model").endswith(SCOPE_SUFFIX)).select(
        F.expr(f"left(model, length(model) - {len(SCOPE_SUFFIX)})").alias("family"),
        "asset", "date", F.col("signal").alias("a"),
    )
    pooled = avg.select(F.col("model").alias("family"), "asset", "date",
                        F.col("signal").alias("b"), F.col("y_true").alias("y"))
    pairs = pooled.join(own, ["family", "asset", "date"]).filter("y is not null")
    # (asset, date) order must survive the pooled copy, so the group key is separate.
    rows = pairs.withColumn("scope", F.explode(F.array(F.col("asset"), F.lit("all"))))
    by = ["family", "scope"]
    if column == "proba":
        right = lambda c: F.avg(((F.col(c) >= 0.5) == (F.col("y") == 1)).cast("double"))
        name, value = "accuracy", right
    else:
        name, value = "rmse", lambda c: metrics.rmse(F.col("y"), F.col(c))
    scores = rows.groupBy(*by).agg(
        F.round(value("b"), 4).alias(f"{name}_pooled"),
        F.round(value("a"), 4).alias(f"{name}_per_asset"),
    )
    dm = diebold_mariano(rows, by, loss="squared", p_values=p_values)
    labels = F.when(F.col("better") == "a", "per_asset").when(F.col("better") == "b", "pooled")
    return (
        dm.filter("n_obs >= 2").join(scores, by)
        .withColumn("better", F.coalesce(labels, F.col("better")))
        .withColumnRenamed("scope", "asset").drop("note", "mean_loss_diff")
    )


def error_breakdown(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = metrics.complete(predictions, "y_true", "pred")
    y, f = F.col("_y"), F.col("_f")
    return rows.groupBy(*by).agg(
        metrics.rmse(y, f).alias("rmse"), metrics.mae(y, f).alias("mae"), F.count(F.lit(1)).alias("n")
    )


def importance_top(importances: DataFrame, k: int = 20) -> DataFrame:
    """Features with the largest mean over folds of the seed-mean gain."""
    per = importances.groupBy("model", "feature", "fold").agg(F.avg("gain").alias("_g"))
    out = per.groupBy("model", "feature").agg(
        F.avg("_g").alias("mean_gain"), F.stddev_samp("_g").alias("std_gain"),
        F.countDistinct("fold").alias("n_folds"),
    )
    w = Window.partitionBy("model").orderBy(F.desc("mean_gain"), "feature")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_stability(importances: DataFrame, k: int = 10) -> DataFrame:
    """How a feature's rank within a fold moves, for the best ``k`` by mean rank."""
    per = importances.groupBy("model", "feature", "fold").agg(F.avg("gain").alias("_g"))
    w = Window.partitionBy("model", "fold").orderBy(F.desc("_g"))
    out = per.withColumn("_r", F.rank().over(w)).groupBy("model", "feature").agg(
        F.avg("_g").alias("mean_gain"),
        F.min("_r").cast("bigint").alias("best_rank"), F.max("_r").cast("bigint").alias("worst_rank"),
        F.stddev_samp("_r").alias("rank_std"),
        (F.max("_r") - F.min("_r")).cast("bigint").alias("rank_range"),
    )
    top = Window.partitionBy("model").orderBy(F.desc("mean_gain"), "feature")
    return out.withColumn("_k", F.row_number().over(top)).filter(F.col("_k") <= k).drop("_k")


def accuracy_over_time(results: DataFrame, metric: str, models: Sequence[str]) -> DataFrame:
    """Fold x model matrix of one metric."""
    return results.groupBy("fold").pivot("model", list(models)).agg(F.avg(metric))
