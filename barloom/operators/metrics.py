"""Forecast metrics as grouped aggregates over prediction rows.

Pairs with a missing side are dropped.  A group without both classes scores NULL on every
classification metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import col, finite, safe_ratio

CLASSIFICATION, REGRESSION, VOLATILITY = "classification", "regression", "volatility"


def task_of(target: str) -> str:
    return {"dir_1d": CLASSIFICATION, "vol_1d": VOLATILITY}.get(target, REGRESSION)


def complete(df: DataFrame, y: str, f: str) -> DataFrame:
    return df.withColumn("_y", finite(col(y))).withColumn("_f", finite(col(f))).filter(
        F.col("_y").isNotNull() & F.col("_f").isNotNull()
    )


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(F.avg((y - f) * (y - f)))


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def r2_oos(y: Column, f: Column, benchmark: Column | float = 0.0) -> Column:
    b = F.lit(benchmark) if isinstance(benchmark, (int, float)) else benchmark
    sse_b = F.sum((y - b) * (y - b))
    return F.when(sse_b > 0, 1 - F.sum((y - f) * (y - f)) / sse_b)


def qlike(y: Column, f: Column) -> Column:
    """Mean of y/f - ln(y/f) - 1; NULL when any variance is not positive."""
    ratio = F.try_divide(F.when(y > 0, y), F.when(f > 0, f))
    return F.when((F.min(y) > 0) & (F.min(f) > 0), F.avg(ratio - F.ln(ratio) - 1))


def regression(df: DataFrame, by: Sequence[str], y="y_true", f="pred", benchmark=0.0) -> DataFrame:
    yy, ff = F.col("_y"), F.col("_f")
    return complete(df, y, f).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"),
        rmse(yy, ff).alias("rmse"),
        mae(yy, ff).alias("mae"),
        r2_oos(yy, ff, benchmark).alias("r2_oos"),
    )


def classification(
    df: DataFrame, by: Sequence[str], y="y_true", proba="proba", pred="pred", threshold=0.5,
) -> DataFrame:
    """Threshold metrics on the probability (the point forecast where it is absent)."""
    score = F.coalesce(F.col(proba), F.col(pred))
    rows = complete(df.withColumn("_score", score), y, "_score")
    rows = rows.withColumn("_up", (F.col("_y") > 0).cast("double")).withColumn(
        "_call", (F.col("_f") >= threshold).cast("double")
    )
    up, call = F.col("_up"), F.col("_call")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum(up * call).alias("_tp"),
        F.sum((1 - up) * (1 - call)).alias("_tn"),
        F.sum((1 - up) * call).alias("_fp"),
        F.sum(up * (1 - call)).alias("_fn"),
        F.avg((F.col("_f") - up) * (F.col("_f") - up)).alias("_brier"),
        F.count(proba).alias("_with_proba"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("_tp", "_tn", "_fp", "_fn"))
    pos, neg = tp + fn, tn + fp
    both = (pos > 0) & (neg > 0)
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(mcc_den > 0, (tp * tn - fp * fn) / mcc_den).otherwise(0.0)
    named = {
        "directional_accuracy": (tp + tn) / F.col("n_obs"),
        "base_rate": pos / F.col("n_obs"),
        "balanced_accuracy": (F.try_divide(tp, pos) + F.try_divide(tn, neg)) / 2,
        "matthews_corrcoef": mcc,
        "brier_score": F.when(F.col("_with_proba") > 0, F.col("_brier")),
    }
    table = counts.select(*by, "n_obs", *[F.when(both, e).alias(n) for n, e in named.items()])
    auc = roc_auc(rows.filter(F.col(proba).isNotNull()), by, "_up", "_f")
    return null_safe_join(table, auc, by)


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of two grouped tables whose keys may be NULL (no seed, say)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in by], *[c for c in right.columns if c not in by])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by]
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in by])


def roc_auc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Exact Mann-Whitney AUC, ties counting one half, without ranking a whole group.

    Scores are first collapsed with counts, so repeated scores cost one row.  They are
    then swept at three resolutions: inside fine buckets, over the fine buckets of each
    coarse bucket, and over the coarse buckets.  Each positive meets every smaller
    negative at exactly one of them, no window spans more than one bucket, and the sweep
    is a chain of group-bys without joins.
    """
    by = list(by)
    s, up = F.col(score), F.col(label)
    unit = F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0))
    t = df.groupBy(*by, s.alias("_s")).agg(
        F.sum(up).alias("_p"), F.sum(1 - up).alias("_n"), F.first(unit).alias("_u")
    )
    t = t.withColumn("_b1", F.floor(F.col("_u") * 2**16)).withColumn(
        "_b2", F.floor(F.col("_u") * 2**36)
    ).withColumn("_a", F.col("_p") * F.col("_n") / 2)
    for keys, order in (
        (["_b1", "_b2"], "_s"),
        (["_b1"], "_b2"),
        ([], "_b1"),
    ):
        w = Window.partitionBy(*by, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("_a", F.col("_a") + F.col("_p") * F.coalesce(F.sum("_n").over(w), F.lit(0.0)))
        t = t.groupBy(*by, *keys).agg(*[F.sum(c).alias(c) for c in ("_p", "_n", "_a")])
    pairs = F.col("_p") * F.col("_n")
    return t.select(*by, F.when(pairs > 0, F.col("_a") / pairs).alias("roc_auc"))


def mincer_zarnowitz(df: DataFrame, by: Sequence[str], y="y_true", f="pred") -> DataFrame:
    """Regression of realised on forecast with the joint test of (0, 1).

    Centred sums give the fit; the F(2, d) tail has a closed form.
    """
    g = complete(df, y, f).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.avg("_y").alias("_my"),
        F.avg("_f").alias("_mf"),
        F.var_pop("_f").alias("_vf"),
        F.var_pop("_y").alias("_vy"),
        F.covar_pop("_y", "_f").alias("_c"),
    )
    n, my, mf, vf, vy, c = (F.col(x) for x in ("_n", "_my", "_mf", "_vf", "_vy", "_c"))
    # Condition number of [[n, sum f], [sum f, sum f^2]] from its two eigenvalues.
    trace, det = n * (1 + vf + mf * mf), n * n * vf
    root = F.sqrt(F.greatest(trace * trace - 4 * det, F.lit(0.0)))
    largest = (trace + root) / 2
    usable = (n >= 3) & (vf > 0) & (largest * largest <= 1e12 * det)
    beta = safe_ratio(c, vf)
    alpha = my - beta * mf
    rss = n * F.greatest(vy - beta * c, F.lit(0.0))
    s2 = rss / (n - 2)
    shift = alpha + (beta - 1) * mf
    f_stat = safe_ratio(n * (shift * shift + (beta - 1) * (beta - 1) * vf), 2 * s2)
    d = n - 2
    p = F.pow(1 + 2 * f_stat / d, -d / 2)
    return g.select(
        *by,
        F.when(usable, alpha).alias("mz_alpha"),
        F.when(usable, beta).alias("mz_beta"),
        F.when(usable & (vy > 0), 1 - rss / (n * vy)).alias("mz_r2"),
        F.when(usable & (s2 > 0), p).alias("mz_joint_p"),
    )


def volatility(df: DataFrame, by: Sequence[str], y="y_true", f="pred", log_scale=True) -> DataFrame:
    """QLIKE, Mincer-Zarnowitz and errors on variances; log errors alongside."""
    rows = complete(df, y, f)
    if log_scale:
        rows = rows.withColumn("_ly", F.col("_y")).withColumn("_lf", F.col("_f"))
        rows = rows.withColumn("_y", F.exp("_ly")).withColumn("_f", F.exp("_lf"))
    yy, ff = F.col("_y"), F.col("_f")
    aggs = [
        F.count(F.lit(1)).alias("n_obs"),
        rmse(yy, ff).alias("rmse"),
        mae(yy, ff).alias("mae"),
        qlike(yy, ff).alias("qlike"),
    ]
    if log_scale:
        aggs += [
            rmse(F.col("_ly"), F.col("_lf")).alias("rmse_log"),
            mae(F.col("_ly"), F.col("_lf")).alias("mae_log"),
        ]
    table = rows.groupBy(*by).agg(*aggs)
    return null_safe_join(table, mincer_zarnowitz(rows, by, "_y", "_f"), by)


def score(df: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """The metric row of each group, by the task the target calls for."""
    task = task_of(target)
    if task == CLASSIFICATION:
        return classification(df, by)
    return volatility(df, by) if task == VOLATILITY else regression(df, by)


def summarise_folds(results: DataFrame, metrics: Sequence[str], by=("model",)) -> DataFrame:
    """Mean, std, min, max and non-null count of each metric."""
    aggs = []
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
            F.count(m).alias(f"{m}_count"),
        ]
    return results.groupBy(*by).agg(*aggs)
