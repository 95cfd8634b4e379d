"""Per-series forecasters: ARMA by two-stage least squares, GARCH by likelihood grids that close in.

Each group is one asset's history inside one fold, bounded by the calendar; Spark spreads
the (fold, asset) groups.  Everything around the recursion (calibration, bounds,
probabilities) is column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.expr import positive_ln
from barloom.operators.baselines import proba_from_forecast

# Fixed values.
ARMA_ORDERS = (0, 1, 2, 3)
ARMA_MIN_OBS = 100
LONG_AR = 12
GARCH_MIN_OBS = 250
STABLE_BELOW = 0.999
DEFAULT_LOG_VAR = math.log(1e-4)
SLOPE_LOW, SLOPE_HIGH, CALIBRATION_MIN, BOUND_SD = 0.05, 5.0, 100, 5.0

GROUP = T.StructType(
    [
        T.StructField("fold", T.IntegerType()),
        T.StructField("asset", T.StringType()),
        T.StructField("date", T.DateType()),
    ]
)


def _history(membership: DataFrame, *extra: str) -> DataFrame:
    """Training and test rows; the validation slice is skipped, as for the baselines."""
    return membership.filter(F.col("split").isin("train", "test")).select(
        "fold", "split", "asset", "date", "ret_lag1", *extra
    )


def _lagged(v: np.ndarray, lags: int, start: int) -> np.ndarray:
    return np.column_stack([v[start - k : len(v) - k] for k in range(1, lags + 1)]) if lags else np.empty((len(v) - start, 0))


def fit_arma(r: np.ndarray, orders: Sequence[int] = ARMA_ORDERS):
    """(const, phi, theta, sigma) with the smallest AIC over the order grid.

    First stage: residuals of a long autoregression.  Second stage: least squares on
    lagged values and lagged residuals, all orders on one common sample.
    """
    long = min(LONG_AR, len(r) // 10)
    x = np.column_stack([np.ones(len(r) - long), _lagged(r, long, long)])
    e = np.zeros(len(r))
    e[long:] = r[long:] - x @ np.linalg.lstsq(x, r[long:], rcond=None)[0]
    start = long + max(orders)
    best = None
    for p, q in product(orders, orders):
        z = np.column_stack([np.ones(len(r) - start), _lagged(r, p, start), _lagged(e, q, start)])
        beta = np.linalg.lstsq(z, r[start:], rcond=None)[0]
        resid = r[start:] - z @ beta
        aic = len(resid) * math.log(max(resid @ resid / len(resid), 1e-300)) + 2 * (p + q + 1)
        if q and np.abs(np.roots(np.r_[1.0, beta[1 + p :]])).max() >= 1:
            continue  # not invertible
        if p and np.abs(np.roots(np.r_[1.0, -beta[1 : 1 + p]])).max() >= 1:
            continue  # not stationary
        if best is None or aic < best[0]:
            best = (aic, beta[0], beta[1 : 1 + p], beta[1 + p :], float(resid.std()) or 1e-6)
    return best[1:]


def arma_path(r: np.ndarray, const: float, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """One-step forecasts: entry ``t`` predicts ``t + 1`` from returns up to ``t``."""
    ar, ma = phi.tolist(), theta.tolist()
    past, shocks = [0.0] * len(ar), [0.0] * len(ma)
    forecast, out = float(const), []
    for value in r.tolist():
        past = [value, *past[:-1]] if ar else past
        shocks = [value - forecast, *shocks[:-1]] if ma else shocks
        forecast = const + sum(a * x for a, x in zip(ar, past)) + sum(b * e for b, e in zip(ma, shocks))
        out.append(forecast)
    return np.array(out)


def arma_predictions(
    membership: DataFrame, target: str = "dir_1d", orders=ARMA_ORDERS, max_obs: int | None = None
) -> DataFrame:
    """ARMA forecasts through the test window with frozen training parameters.

    All training returns are used; ``max_obs`` keeps only the latest so many.
    """
    schema = T.StructType([*GROUP.fields, T.StructField("f", T.DoubleType()), T.StructField("sigma", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train = pdf.loc[pdf["split"] == "train", "ret_lag1"].dropna().to_numpy(float)
        train = train[-max_obs:] if max_obs else train
        test = pdf[pdf["split"] == "test"]
        out = test[["fold", "asset", "date"]].copy()
        out["f"], out["sigma"] = 0.0, 1e-2
        if len(train) >= ARMA_MIN_OBS and len(test):
            const, phi, theta, sigma = fit_arma(train, orders)
            clean = test["ret_lag1"].ffill().fillna(0.0).to_numpy(float)
            out["f"] = arma_path(np.r_[train, clean], const, phi, theta)[len(train) :]
            out["sigma"] = sigma
        return out

    paths = _history(membership).groupBy("fold", "asset").applyInPandas(run, schema)
    truth = membership.filter("split = 'test'").select("fold", "asset", "date", F.col(target).alias("y_true"))
    direction = target == "dir_1d"
    pred = (F.col("f") > 0).cast("double") if direction else F.col("f")
    proba = proba_from_forecast(F.col("f"), F.col("sigma")) if direction else F.lit(None)
    return truth.join(paths, ["fold", "asset", "date"]).select(
        "asset", "date", pred.alias("pred"), proba.cast("double").alias("proba"), F.lit("arima").alias("model"),
        "fold", F.lit(None).cast("int").alias("seed"), F.lit(target).alias("target"), "y_true",
    )


# -- conditional variance -------------------------------------------------------------

MEAN_ABS = math.sqrt(2 / math.pi)


def variance_path(e: np.ndarray, s2: float, variant: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Variance of each day given the day before, for a vector of (a, b) parameters.

    The long-run level is tied to the training variance ``s2``.  The result has one more
    row than ``e``: its last row is the variance of the next, unseen day.
    """
    out = np.empty((len(e) + 1, len(a)))
    out[0] = s2
    if variant == "garch11":
        omega = s2 * (1 - a - b)
        for t in range(len(e)):
            out[t + 1] = omega + a * e[t] ** 2 + b * out[t]
        return np.maximum(out, 1e-300)
    level = math.log(s2)
    log_h = np.full(len(a), level)
    for t in range(len(e)):
        z = np.abs(e[t]) * np.exp(-0.5 * log_h)
        log_h = np.clip(level * (1 - b) + a * (z - MEAN_ABS) + b * log_h, level - 40, level + 40)
        out[t + 1] = np.exp(log_h)
    return out


def squared_t_loglik(q: np.ndarray, h: np.ndarray, nu: float) -> np.ndarray:
    """Student-t log likelihood of squared residuals ``q`` (rows) under variances ``h`` (rows x candidates)."""
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log((nu - 2) * math.pi)
    return (const - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(q[:, None] / h / (nu - 2))).sum(axis=0)


# Parameter grids: reaction, persistence (sum for GARCH, autoregression for EGARCH), tails.
REACTION = {"garch11": (0.02, 0.04, 0.06, 0.09, 0.13, 0.18, 0.25), "egarch11": (0.03, 0.06, 0.1, 0.15, 0.22, 0.32)}
PERSISTENCE = (0.3, 0.5, 0.7, 0.8, 0.88, 0.93, 0.96, 0.98, 0.99, 1.0)
TAILS = (3.0, 4.0, 6.0, 9.0, 15.0, 40.0)


STEPS = (-0.5, -0.25, 0.0, 0.25, 0.5)
TAIL_MIN, TAIL_MAX = 2.05, 200.0

# A search ends after STILL_ROUNDS rounds in a row, each on half the width, that gain less than TOLERANCE.
TOLERANCE, STILL_ROUNDS, MAX_ROUNDS = 1e-3, 4, 60


def candidates(variant: str, best: tuple[float, float, float] | None = None, width: float = 1.0):
    """(a, b, tails) to try next: the fixed grid at first, then a grid around the best (a, b, nu) so far."""
    if best is None:
        reaction, persistence, tails = REACTION[variant], PERSISTENCE, TAILS
    else:
        a0, b0, nu0 = best
        g0 = a0 + b0 if variant == "garch11" else b0
        moves = [width * d for d in STEPS]
        reaction = [a0 * (1 + d) for d in moves]
        persistence = sorted({min(g0 + d * (1.001 - g0), 1.0) for d in moves})
        tails = sorted({min(max(nu0 * (1 + d), TAIL_MIN), TAIL_MAX) for d in moves})
    pairs = [(a, g - a if variant == "garch11" else g) for a in reaction for g in persistence]
    a, b = (np.array(v, float) for v in zip(*[(a, max(b, 0.0)) for a, b in pairs if b >= -1e-12]))
    return a, b, np.array(tails, float)


def closer(best: float | None, score: float, width: float, still: int, tolerance: float) -> tuple[float, int]:
    """(width, still) after a round: a round without a gain halves the width and counts towards the end."""
    if best is not None and score - best < tolerance:
        return width / 2, still + 1
    return width, 0


def fit_variance(e: np.ndarray, variant: str, tolerance: float = TOLERANCE) -> tuple[float, float, float]:
    """(a, b, nu) of the largest Student-t likelihood, by grids that close in until the gain settles."""
    s2, q = float(np.mean(e**2)), e**2
    found, best, width, still = None, None, 1.0, 0
    for _ in range(MAX_ROUNDS):
        a, b, tails = candidates(variant, found, width)
        h = variance_path(e, s2, variant, a, b)[:-1]
        scores = np.array([squared_t_loglik(q, h, nu) for nu in tails])
        i, j = np.unravel_index(np.argmax(scores), scores.shape)
        width, still = closer(best, float(scores[i, j]), width, still, tolerance)
        found, best = (float(a[j]), float(b[j]), float(tails[i])), float(scores[i, j])
        if still >= STILL_ROUNDS:
            break
    return found


def is_stable(variant: str, a: float, b: float) -> bool:
    return (a + b if variant == "garch11" else abs(b)) < STABLE_BELOW


def variance_paths(membership: DataFrame, variant: str) -> DataFrame:
    """Per row of train and test: variance of the day, of the next day, and the fallback.

    ``fitted`` is false where the series is too short or its recursion does not settle.
    """
    schema = T.StructType(
        [*GROUP.fields, T.StructField("split", T.StringType()), T.StructField("h_now", T.DoubleType()),
         T.StructField("h_next", T.DoubleType()), T.StructField("fallback", T.DoubleType()),
         T.StructField("fitted", T.BooleanType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        train = pdf[pdf["split"] == "train"].dropna(subset=["ret_lag1"])
        test = pdf[pdf["split"] == "test"]
        rows = pd.concat([train, test])
        out = rows[["fold", "asset", "date", "split"]].copy()
        out["h_now"] = out["h_next"] = np.nan
        out["fallback"], out["fitted"] = DEFAULT_LOG_VAR, False
        r = train["ret_lag1"].to_numpy(float)
        if len(r) < GARCH_MIN_OBS or not r.std() > 0:
            return out
        out["fallback"] = math.log(max(r.var(ddof=1), 1e-12))
        mu = r.mean()
        a, b, _ = fit_variance(r - mu, variant)
        if not is_stable(variant, a, b):
            return out
        clean = test["ret_lag1"].ffill().fillna(0.0).to_numpy(float)
        s2 = float(np.mean((r - mu) ** 2))
        h = variance_path(np.r_[r, clean] - mu, s2, variant, np.array([a]), np.array([b]))[:, 0]
        out["h_now"], out["h_next"], out["fitted"] = h[:-1], h[1:], True
        return out

    return _history(membership).groupBy("fold", "asset").applyInPandas(run, schema)


def calibrate(train: DataFrame, model_log: Column, realised_log: Column, mode: str = "level") -> DataFrame:
    """(fold, asset) -> intercept and slope mapping model log variance to the measure."""
    x, y = model_log, realised_log
    both = x.isNotNull() & y.isNotNull()
    g = train.filter(both).groupBy("fold", "asset").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(y - x).alias("_gap"),
        F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_icpt"),
    )
    enough = F.col("_n") >= CALIBRATION_MIN
    use = enough & (F.lit(mode) == "mz") & (F.col("_slope") > SLOPE_LOW) & (F.col("_slope") < SLOPE_HIGH)
    shift = F.when(use, F.col("_icpt")).when(enough & (F.lit(mode) != "none"), F.col("_gap")).otherwise(0.0)
    return g.select("fold", "asset", shift.alias("intercept"), F.when(use, F.col("_slope")).otherwise(1.0).alias("slope"))


def variance_predictions(membership: DataFrame, variant: str = "garch11", mode: str = "level") -> DataFrame:
    """Calibrated log of the next day's variance on test rows.

    Training rows alone fix the parameters, the calibration and the plausible range.
    """
    paths = variance_paths(membership, variant)
    rv = membership.select("fold", "asset", "date", positive_ln("realised_var_now").alias("_rv"), F.col("vol_1d").alias("y_true"))
    df = paths.join(rv, ["fold", "asset", "date"])
    train = df.filter("split = 'train'")
    floor = F.when(F.col("h_now").isNotNull() & ~F.isnan("h_now"), F.greatest("h_now", F.lit(1e-16)))
    cal = calibrate(train, F.ln(floor), F.col("_rv"), mode)
    span = train.groupBy("fold", "asset").agg(F.avg("_rv").alias("_c"), F.stddev_samp("_rv").alias("_s"))
    test = df.filter("split = 'test'").join(cal, ["fold", "asset"], "left").join(span, ["fold", "asset"], "left")
    icpt, slope = F.coalesce("intercept", F.lit(0.0)), F.coalesce("slope", F.lit(1.0))
    raw = icpt + slope * F.ln(F.greatest("h_next", F.lit(1e-12)))
    lo, hi = F.col("_c") - BOUND_SD * F.col("_s"), F.col("_c") + BOUND_SD * F.col("_s")
    bound = F.when(lo.isNotNull(), F.least(F.greatest(raw, lo), hi)).otherwise(raw)
    fallback = F.when(F.col("fitted"), icpt + slope * F.col("fallback")).otherwise(F.col("fallback"))
    pred = F.when(F.col("fitted"), bound).otherwise(fallback)
    name = variant if mode == "level" else f"{variant}_{mode}"
    return test.select(
        "asset", "date", F.coalesce(pred, fallback).alias("pred"), F.lit(None).cast("double").alias("proba"),
        F.lit(name).alias("model"), "fold", F.lit(None).cast("int").alias("seed"), F.lit("vol_1d").alias("target"), "y_true",
    )
