"""Linear forecaster on the trend and seasonal parts of every column's lookback window.

The window of a row is its last ``lookback`` rows times all columns; with 30 rows of 80 columns it is never built.  All that a
least-squares fit needs is the sum of products of lagged rows over the fitted rows, and along each diagonal of lags
that sum only changes at the ends of a run of fitted rows.  So a series is reduced to the products at lag zero
against every lag, one row of lagged values before each run and one at its end.  These summaries add up over series,
so one pooled fit and the per-asset fits come from the same pass, and a pooled fit never gathers rows.

Trend and seasonal parts are a fixed linear map of the window.  Of all weights on the two parts that act alike on the window
the penalty picks the smallest, so it is a quadratic form of the weights on the window itself.  Each asset has an
additive offset without penalty, which centring by asset leaves out.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.linear import ALPHAS, COEF_SCHEMA, FALLBACK_ALPHA, MIN_TRAIN_ROWS, POOLED, SUFFIX
from barloom.plans.session import cut_lineage

FAN = 8
SUMMARY = (
    "fold int, scope string, split string, n long, sy double, syy double, yy double, sw binary, wy binary, "
    "lags binary, plus binary, minus binary, fix_plus binary, fix_minus binary"
)
NAMES = [f.split()[0] for f in SUMMARY.split(", ")]


@dataclass
class Summary:
    """Sums over fitted rows; ``plus`` to ``fix_minus`` hold rows whose outer products belong to the sums.

    ``wy``, ``yy`` and the fixed rows are about the training means of each asset; ``sy``, ``syy`` and ``sw`` are plain.
    """

    n: int
    sy: float
    syy: float
    yy: float
    sw: np.ndarray
    wy: np.ndarray
    lags: np.ndarray
    plus: np.ndarray
    minus: np.ndarray
    fix_plus: np.ndarray
    fix_minus: np.ndarray

    def row(self, fold: int, scope: str, split: str) -> list:
        values = [getattr(self, f.name) for f in fields(self)]
        return [fold, scope, split, *[np.ascontiguousarray(v).tobytes() if isinstance(v, np.ndarray) else v for v in values]]

    @classmethod
    def read(cls, row, lookback: int) -> Summary:
        wide = len(row.sw) // 8
        many = lambda raw, *shape: np.frombuffer(raw).reshape(shape)
        factors = [many(getattr(row, c), -1, wide) for c in ("plus", "minus", "fix_plus", "fix_minus")]
        lags = many(row.lags, lookback, wide // lookback, wide // lookback)
        return cls(row.n, row.sy, row.syy, row.yy, many(row.sw, wide), many(row.wy, wide), lags, *factors)

    def bounded(self) -> Summary:
        """Factor rows beyond the width are replaced by a triangular factor with the same outer products."""
        for name in ("plus", "minus", "fix_plus", "fix_minus"):
            rows = getattr(self, name)
            if len(rows) > rows.shape[1]:
                setattr(self, name, np.linalg.qr(rows, mode="r"))
        return self


def merge(parts: Iterable[Summary]) -> Summary:
    parts = list(parts)
    out = {}
    for f in fields(Summary):
        values = [getattr(p, f.name) for p in parts]
        out[f.name] = np.concatenate(values) if f.name in ("plus", "minus", "fix_plus", "fix_minus") else sum(values)
    return Summary(**out).bounded()


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of every stretch of marked rows."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def summarise(z: np.ndarray, y: np.ndarray, mask: np.ndarray, lookback: int, centre: Summary | None = None) -> Summary:
    """Sums over the marked rows of one series, about the means of ``centre`` (training rows) or their own."""
    width = z.shape[1]
    padded = np.vstack([np.zeros((lookback, width)), z])
    lags = np.zeros((lookback, width, width))
    sw, wy = np.zeros((lookback, width)), np.zeros((lookback, width))
    plus, minus = [], []
    for first, last in runs(mask):
        now, target = z[first : last + 1], y[first : last + 1]
        for lag in range(lookback):
            then = padded[lookback + first - lag : lookback + last + 1 - lag]
            lags[lag] += now.T @ then
            sw[lag] += then.sum(axis=0)
            wy[lag] += target @ then
        # the rows one step before the run's windows and the ones its windows end with, newest first
        plus.append(padded[first : lookback + first][::-1].ravel())
        minus.append(padded[last + 1 : lookback + last + 1][::-1].ravel())
    n, t = int(mask.sum()), y[mask]
    sw, wy, sy, syy = sw.ravel(), wy.ravel(), float(t.sum()), float(t @ t)
    rows = lambda r: np.array(r, float).reshape(-1, lookback * width)
    if centre is None:
        mean_w, mean_y = (sw / n, sy / n) if n else (sw, 0.0)
        fix_plus = []
    else:
        mean_w, mean_y = centre.sw / centre.n, centre.sy / centre.n
        fix_plus = [n**0.5 * (sw / n - mean_w)] if n else []
    fix_minus = [sw / n**0.5] if n else []
    wy = wy - mean_w * sy - mean_y * sw + n * mean_w * mean_y
    yy = float(((t - mean_y) ** 2).sum())
    return Summary(n, sy, syy, yy, sw, wy, lags, rows(plus), rows(minus), rows(fix_plus), rows(fix_minus))


def products(s: Summary) -> np.ndarray:
    """Centred cross products of all lagged columns, lag-major."""
    lookback, width, _ = s.lags.shape
    wide = lookback * width
    ends = (s.plus.T @ s.plus - s.minus.T @ s.minus).reshape(lookback, width, lookback, width)
    g = np.zeros((lookback, width, lookback, width))
    g[0] = s.lags.transpose(1, 0, 2)
    for lag in range(1, lookback):
        g[lag, :, lag:] = g[lag - 1, :, lag - 1 : -1] + ends[lag - 1, :, lag - 1 : -1]
    g = np.triu(g.reshape(wide, wide))
    g += np.triu(g, 1).T
    return g - s.fix_minus.T @ s.fix_minus + s.fix_plus.T @ s.fix_plus


def moving_average(lookback: int, kernel: int) -> np.ndarray:
    """Matrix of the centred moving average with repeated edges, rows and columns from the oldest on."""
    half = (kernel - 1) // 2
    m = np.zeros((lookback, lookback))
    for i in range(lookback):
        for j in range(i - half, i + kernel - half):
            m[i, min(max(j, 0), lookback - 1)] += 1.0 / kernel
    return m


def penalty(lookback: int, kernel: int) -> np.ndarray:
    """Over lags (newest first): the smallest squared weights on both parts that act as given weights on the window."""
    m = moving_average(lookback, kernel)
    rest = np.eye(lookback) - m
    return np.linalg.inv(m.T @ m + rest.T @ rest)[::-1, ::-1]


def solve(train: Summary, val: Summary | None, kernel: int, alphas: Sequence[float]) -> tuple[float, np.ndarray]:
    """The penalty with the smallest validation error and its weights; the fallback where validation cannot tell."""
    lookback, width, _ = train.lags.shape
    g = products(train)
    pen = penalty(lookback, kernel)

    def weights(alpha: float) -> np.ndarray:
        a = g.copy().reshape(lookback, width, lookback, width)
        for f in range(width):
            a[:, f, :, f] += alpha * pen
        return np.linalg.solve(a.reshape(g.shape), train.wy)

    if val is None or val.n == 0 or val.syy - val.sy**2 / val.n <= 0:
        return FALLBACK_ALPHA, weights(FALLBACK_ALPHA)
    seen = products(val)
    fits = [(a, weights(a)) for a in alphas]
    return min(fits, key=lambda f: val.yy - 2 * val.wy @ f[1] + f[1] @ seen @ f[1])


def series_summaries(rows: DataFrame, lookback: int) -> DataFrame:
    """A summary of the training and one of the validation rows of every (fold, asset)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        z, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float)
        known = ~np.isnan(y)
        fold, scope = int(pdf["fold"].iloc[0]), pdf["asset"].iloc[0]
        train = summarise(z, np.nan_to_num(y), known & (pdf["split"] == "train").to_numpy(), lookback)
        if not train.n:
            return pd.DataFrame(columns=NAMES)
        val = summarise(z, np.nan_to_num(y), known & (pdf["split"] == "val").to_numpy(), lookback, train)
        return pd.DataFrame([train.row(fold, scope, "train"), val.row(fold, scope, "val")], columns=NAMES)

    return rows.groupBy("fold", "asset").applyInPandas(run, SUMMARY)


def pool(summaries: DataFrame, lookback: int) -> DataFrame:
    """The sum over assets, by a tree whose nodes add at most about FAN summaries (each bounded by the width)."""
    merged = lambda pdf: merge(Summary.read(r, lookback) for r in pdf.itertuples())

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        row = merged(pdf).row(int(pdf["fold"].iloc[0]), str(pdf["node"].iloc[0]), pdf["split"].iloc[0])
        return pd.DataFrame([row], columns=NAMES)

    nodes = summaries.select("scope").distinct().count()
    key = F.pmod(F.xxhash64("scope"), F.lit(max(1, -(-nodes // FAN))))
    while nodes > 1:
        nodes = -(-nodes // FAN)
        summaries = summaries.withColumn("node", key).groupBy("fold", "split", "node").applyInPandas(add, SUMMARY)
        key = F.floor(F.col("scope").cast("long") / FAN)
    return summaries.withColumn("scope", F.lit(POOLED))


def fit(
    rows: DataFrame, lookback: int = 30, kernel: int = 7, alphas: Sequence[float] = ALPHAS, min_rows: int = MIN_TRAIN_ROWS
) -> DataFrame:
    """Weights (lag-major) of the pooled scope and of every asset with enough training rows, for all folds.

    The intercept is the offset of an asset that the training rows do not hold.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {r.split: Summary.read(r, lookback) for r in pdf.itertuples()}
        train, fold, scope = parts.get("train"), int(pdf["fold"].iloc[0]), pdf["scope"].iloc[0]
        if train is None or (scope != POOLED and train.n < min_rows):
            return pd.DataFrame(columns=COEF_SCHEMA.fieldNames())
        alpha, beta = solve(train, parts.get("val"), kernel, alphas)
        intercept = (train.sy - train.sw @ beta) / train.n
        row = [fold, scope, alpha, float(intercept), beta.tolist(), train.n]
        return pd.DataFrame([row], columns=COEF_SCHEMA.fieldNames())

    own = cut_lineage(series_summaries(rows, lookback))
    return own.unionByName(pool(own, lookback)).groupBy("fold", "scope").applyInPandas(run, COEF_SCHEMA)


def window_dots(z: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Weights (lag, column) applied to the window of every row, rows before the first being zero."""
    dots, out = z @ beta.T, np.zeros(len(z))
    for lag in range(min(len(beta), len(z))):
        out[lag:] += dots[: len(z) - lag, lag]
    return out


def predict(rows: DataFrame, coefs: DataFrame, model: str, target: str, lookback: int = 30) -> DataFrame:
    """Forecasts of the test rows in both scopes; an asset's own scope without a fit leaves NULL.

    A binary target is forecast as a probability, cut at 0 and 1.
    """
    binary = target == "dir_1d"
    schema = "asset string, date date, pred double, proba double, model string, fold int, seed int, target string, y_true double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        left = left.sort_values("date")
        z, y = np.stack(left["x"].to_numpy()).astype(float), left["y"].to_numpy(float)
        test, train = (left["split"] == "test").to_numpy(), (left["split"] == "train").to_numpy() & ~np.isnan(y)
        fits, frames = {r.scope: r for r in right.itertuples()}, []
        for scope, suffix in ((POOLED, ""), (left["asset"].iloc[0], SUFFIX)):
            found = fits.get(scope)
            value = np.full(int(test.sum()), np.nan)
            if found is not None:
                raw = window_dots(z, np.asarray(found.coef, float).reshape(lookback, -1))
                value = (raw + ((y - raw)[train].mean() if train.any() else found.intercept))[test]
            out = left.loc[test, ["asset", "date", "fold"]].assign(model=model + suffix, seed=None, target=target, y_true=y[test])
            proba = np.clip(value, 0, 1) if binary else np.full(len(value), np.nan)
            pred = np.where(np.isnan(value), np.nan, value >= 0.5) if binary else value
            frames.append(out.assign(pred=pred, proba=proba))
        both = pd.concat(frames).astype({"seed": "Int32"})
        return both.astype({c: object for c in ("pred", "proba", "y_true")}).where(lambda v: v.notna(), None)[[c.split()[0] for c in schema.split(", ")]]

    keys = rows.groupBy("fold", "asset").count().select(F.col("fold").alias("in_fold"), F.col("asset").alias("of_asset"))
    fits = coefs.select(F.col("fold").alias("of_fold"), "scope", "intercept", "coef")
    mine = (F.col("scope") == POOLED) | (F.col("scope") == F.col("of_asset"))
    reach = keys.join(fits, (F.col("in_fold") == F.col("of_fold")) & mine)
    return rows.groupBy("fold", "asset").cogroup(reach.groupBy("in_fold", "of_asset")).applyInPandas(run, schema)
