"""Exploratory statistics of a panel: moments, correlations, autocorrelation and
stationarity tests.  A series is one asset's history, bounded by the calendar."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import moments
from barloom.functions.expr import safe_ratio
from barloom.functions.normal import normal_pdf
from barloom.functions.series import Series
from barloom.functions.tails import chi2_p_value
from barloom.operators.cross_asset import calendar_series

# KPSS (level) critical values and their p-values, and the coefficients of
# the finite-sample ADF critical values with a constant (1 %, 5 %, 10 %).
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
ADF_CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786),
    "crit_5": (-2.86154, -2.8903, -4.234),
    "crit_10": (-2.56677, -1.5384, -2.809),
}


def log_returns(panel: DataFrame) -> DataFrame:
    r = Series().diff(F.ln("close"))
    return panel.select("asset", "date", r.alias("r")).filter("r is not null")


def rebased_price(panel: DataFrame) -> DataFrame:
    s = Series()
    first = F.first("close", ignorenulls=True).over(s.running)
    return panel.select("asset", "date", safe_ratio(F.col("close"), first).alias("rebased"))


def return_histogram(panel: DataFrame, bins: int = 150) -> DataFrame:
    """Equal-width density per asset with the fitted normal density at bin centres."""
    r = log_returns(panel)
    span = r.groupBy("asset").agg(
        F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("r").alias("n"),
        F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    slot = F.least(F.floor((F.col("r") - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    counts = r.join(span.select("asset", "lo", "width"), "asset").groupBy(
        "asset", slot.cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("count"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    return every.join(counts, ["asset", "bin"], "left").select(
        "asset", "bin", centre.alias("centre"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / (F.col("n") * F.col("width"))).alias("density"),
        normal_pdf(centre, F.col("mu"), F.col("sd")).alias("normal_density"),
    )


def return_moments(panel: DataFrame, periods: int = 365) -> DataFrame:
    return log_returns(panel).groupBy("asset").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"),
        (F.stddev_samp("r") * math.sqrt(periods)).alias("annual_vol"),
        moments.skew("r").alias("skew"), moments.kurt("r").alias("excess_kurtosis"),
        F.min("r").alias("min"), F.max("r").alias("max"),
    )


def wide_returns(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    """One row per date, one column per named asset."""
    return log_returns(panel).groupBy("date").pivot("asset", list(assets)).agg(F.first("r"))


def asset_names(panel: DataFrame) -> list[str]:
    """Sorted names of the panel's assets: a schema-sized list."""
    return [r["asset"] for r in panel.select("asset").distinct().orderBy("asset").collect()]


def pairwise_correlation(panel: DataFrame) -> DataFrame:
    """Correlation and overlap of every two assets over their common dates, as rows.

    The dates' pairs go straight into a partial aggregate, so the shuffle after it holds one row per asset pair and
    task; the pairs are rows, so the plan does not grow with the number of assets.
    """
    r = log_returns(panel).filter(F.col("r").isNotNull())
    day = r.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("asset", "r"))).alias("_s"))
    pair = F.expr("flatten(transform(_s, (x, i) -> transform(slice(_s, i + 1, size(_s)), y -> struct(x, y))))")
    pairs = day.select(F.explode(pair).alias("_p")).select(
        F.col("_p.x.asset").alias("asset_a"), F.col("_p.y.asset").alias("asset_b"),
        F.col("_p.x.r").alias("_a"), F.col("_p.y.r").alias("_b"),
    )
    return pairs.groupBy("asset_a", "asset_b").agg(
        moments.corr("_a", "_b").alias("corr"), F.count(F.lit(1)).alias("overlap")
    )


def rolling_correlation(
    panel: DataFrame, assets: Sequence[str], window: int = 90, min_periods: int = 60
) -> DataFrame:
    """(date, asset_a, asset_b, corr) on the calendar of dates in the panel."""
    wide = wide_returns(panel, assets)
    cal = calendar_series()
    pairs = [(a, b) for a, b in combinations_with_replacement(assets, 2) if a != b]
    wide = wide.withColumns(
        {f"_c{i}": cal.corr(a, b, window, min_periods) for i, (a, b) in enumerate(pairs)}
    )
    cells = [
        F.struct(F.lit(a).alias("asset_a"), F.lit(b).alias("asset_b"), F.col(f"_c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select("date", F.explode(F.array(*cells)).alias("_c")).select("date", "_c.*")


def describe_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, moments and quartiles of groups bounded by the calendar."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q"),
    )
    return out.select(
        *by, "count", "mean", "std", "min",
        *[F.get("_q", i).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max",
    )


def transforms(returns: DataFrame) -> DataFrame:
    """Long form of r, |r| and r squared."""
    r = F.col("r")
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), v.alias("x")) for k, v in (("r", r), ("abs", F.abs(r)), ("sq", r * r))]
    )
    return returns.select("asset", "date", F.explode(kinds).alias("_k")).select("asset", "date", "_k.*")


def autocovariance(long: DataFrame, max_lag: int, keys=("asset", "kind")) -> DataFrame:
    """(keys, lag, gamma, n) with the biased divisor n, lags 0..max_lag."""
    s = Series(keys=keys)
    centred = F.col("x") - F.avg("x").over(Window.partitionBy(*keys))
    df = long.withColumn("_d", centred)
    df = df.withColumns({f"_p{k}": F.col("_d") * (s.lag("_d", k) if k else F.col("_d")) for k in range(max_lag + 1)})
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(max_lag + 1)]
    )
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_p{k}") / F.col("n")).alias("gamma")) for k in range(max_lag + 1)])
    return g.select(*keys, "n", F.explode(cells).alias("_c")).select(*keys, "n", "_c.*")


def acf(panel: DataFrame, max_lag: int = 40) -> DataFrame:
    """Autocorrelations of r, |r| and r squared with the 95 % band."""
    g = autocovariance(transforms(log_returns(panel)), max_lag)
    g0 = F.max(F.when(F.col("lag") == 0, F.col("gamma"))).over(Window.partitionBy("asset", "kind"))
    return g.withColumn("acf", F.try_divide("gamma", g0)).filter("lag > 0").select(
        "asset", "kind", "n", "lag", "acf", (1.96 / F.sqrt("n")).alias("band")
    )


def acf_summary(table: DataFrame, lags: int = 21) -> DataFrame:
    """Largest absolute autocorrelation of the first lags, and as a multiple of the band."""
    top = table.filter(F.col("lag") <= lags).groupBy("asset", "kind").agg(
        F.max(F.abs("acf")).alias("max_abs"), F.max("band").alias("band")
    )
    return top.withColumn("ratio", F.col("max_abs") / F.col("band"))


def _durbin_levinson(rho: np.ndarray) -> list[float]:
    out, phi = [], np.zeros(0)
    for k in range(1, len(rho) + 1):
        past = rho[: k - 1]
        last = (rho[k - 1] - phi @ past[::-1]) / (1.0 - phi @ past) if k > 1 else rho[0]
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out


def pacf(table: DataFrame) -> DataFrame:
    """Partial autocorrelations from the (at most forty) autocorrelations of a series."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(rho: pd.Series) -> pd.Series:
        return rho.map(lambda a: _durbin_levinson(np.asarray(a, float)))

    ordered = F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda c: c["acf"])
    arrays = table.groupBy("asset", "kind").agg(ordered.alias("_rho"))
    return arrays.select("asset", "kind", F.posexplode(solve("_rho")).alias("_i", "pacf")).select(
        "asset", "kind", (F.col("_i") + 1).alias("lag"), "pacf"
    )


def ljung_box(table: DataFrame, horizons: Sequence[int] = (5, 10, 21), p_values: bool = True) -> DataFrame:
    """Portmanteau statistic of each series at each horizon, its p-value and 5 % flag."""
    term = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    rows = table.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    out = rows.filter("lag <= horizon").groupBy("asset", "kind", "horizon").agg(
        (F.max("n") * (F.max("n") + 2) * F.sum(term)).alias("q_stat")
    )
    if not p_values:
        return out
    p = chi2_p_value(F.col("q_stat"), F.col("horizon").cast("double"))
    return out.withColumn("p_value", p).withColumn("reject", F.col("p_value") < 0.05)


def ljung_box_counts(tests: DataFrame) -> DataFrame:
    return tests.groupBy("kind", "horizon").agg(
        F.count(F.lit(1)).alias("n_series"), F.sum(F.col("reject").cast("bigint")).alias("n_reject")
    )


def kpss_statistic(x: np.ndarray) -> tuple[float, int]:
    """KPSS statistic around a level; Bartlett variance with the automatic bandwidth."""
    d = x - x.mean()
    n = len(d)
    spectrum = np.fft.rfft(d, 2 * n)
    gamma = np.fft.irfft(np.abs(spectrum) ** 2)[:n] / n
    k = np.arange(1, int(n ** (2 / 9)) + 1)
    s0 = gamma[0] + 2 * gamma[k].sum()
    s1 = 2 * (k * gamma[k]).sum()
    width = 1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)
    lags = min(int(width), n - 1)
    k = np.arange(1, lags + 1)
    variance = gamma[0] + 2 * ((1 - k / (lags + 1)) * gamma[k]).sum()
    return float((np.cumsum(d) ** 2).sum() / n**2 / variance), lags


def kpss(panel: DataFrame) -> DataFrame:
    """Level-stationarity statistic and its table p-value, one series per group.

    The bandwidth depends on the data and may reach the length of the series, so the
    autocovariances are taken per series rather than as a fixed set of lag columns.
    """
    fields = [T.StructField("asset", T.StringType()), T.StructField("lags", T.IntegerType()),
              T.StructField("kpss_stat", T.DoubleType()), T.StructField("kpss_pvalue", T.DoubleType())]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stat, lags = kpss_statistic(pdf.sort_values("date")["r"].to_numpy(float))
        p = float(np.interp(stat, *zip(*KPSS_CRITICAL)))
        return pd.DataFrame([{"asset": pdf["asset"].iloc[0], "lags": lags, "kpss_stat": stat, "kpss_pvalue": p}])

    return log_returns(panel).groupBy("asset").applyInPandas(run, T.StructType(fields))


def _adf_regression(y: np.ndarray, lag: int, start: int):
    """OLS of the difference on level, constant and lagged differences from ``start``."""
    d = np.diff(y)
    cols = [y[start:-1], np.ones(len(d) - start)]
    cols += [d[start - k : len(d) - k] for k in range(1, lag + 1)]
    x, target = np.column_stack(cols), d[start:]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    resid = target - x @ beta
    return x, beta, float(resid @ resid)


def adf_statistic(y: np.ndarray) -> tuple[float, int, int]:
    """Augmented Dickey-Fuller t statistic; lag order by AIC on a common sample."""
    n = len(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    best, order = math.inf, 0
    for lag in range(top + 1):
        x, beta, rss = _adf_regression(y, lag, top)
        aic = len(x) * (math.log(rss / len(x)) + math.log(2 * math.pi) + 1) + 2 * len(beta)
        if aic < best:
            best, order = aic, lag
    x, beta, rss = _adf_regression(y, order, order)
    cov = np.linalg.inv(x.T @ x) * rss / (len(x) - x.shape[1])
    return float(beta[0] / math.sqrt(cov[0, 0])), order, len(x)


def adf(panel: DataFrame) -> DataFrame:
    """ADF statistic with 1, 5 and 10 % critical values, one series per group."""
    fields = [T.StructField("asset", T.StringType()), T.StructField("adf_stat", T.DoubleType()),
              T.StructField("adf_lags", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ADF_CRITICAL]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stat, order, n = adf_statistic(pdf.sort_values("date")["r"].to_numpy(float))
        crit = {k: b0 + b1 / n + b2 / n**2 for k, (b0, b1, b2) in ADF_CRITICAL.items()}
        return pd.DataFrame([{"asset": pdf["asset"].iloc[0], "adf_stat": stat, "adf_lags": order, **crit}])

    return log_returns(panel).groupBy("asset").applyInPandas(run, T.StructType(fields))


def stationarity(panel: DataFrame) -> DataFrame:
    """Both tests and their joint reading at 5 %."""
    both = adf(panel).join(kpss(panel), "asset")
    unit_root_rejected = F.col("adf_stat") < F.col("crit_5")
    level_rejected = F.col("kpss_pvalue") < 0.05
    verdict = (
        F.when(unit_root_rejected & ~level_rejected, "stationary")
        .when(~unit_root_rejected & level_rejected, "unit root")
        .when(unit_root_rejected & level_rejected, "conflict")
        .otherwise("inconclusive")
    )
    return both.withColumn("verdict", verdict)
