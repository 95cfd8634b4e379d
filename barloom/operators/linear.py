"""Ridge and logistic forecasters for every fold and scope at once.

A *scope* is the set of rows one fit sees: all assets of a fold (``*``) or one asset.
Pooled fits never gather rows: each task reduces its rows to cross-product matrices per
fold, those are summed in two levels and only then solved.  Per-asset fits are grouped by
(fold, asset), one series bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POOLED = "*"
SUFFIX = "_per_asset"
# Fixed values.
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
FALLBACK_ALPHA = 10.0
MIN_TRAIN_ROWS = 500
FAN = 64
NEWTON_STEPS = 60

COEF_SCHEMA = T.StructType(
    [
        T.StructField("fold", T.IntegerType()),
        T.StructField("scope", T.StringType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("n_train", T.LongType()),
    ]
)


def design(membership: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(fold, split, asset, date, x, y): features packed into one array column."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    return membership.select("fold", "split", "asset", "date", x.alias("x"), F.col(target).alias("y"))


def _fit_rows(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("split") != "test") & F.col("y").isNotNull()).select(
        "fold", "split", "asset", "x", "y"
    )


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    """[1, x, y] rows of a frame."""
    x = np.stack(pdf["x"].to_numpy()).astype(float)
    return np.column_stack([np.ones(len(x)), x, pdf["y"].to_numpy(float)])


def _gram(pdf: pd.DataFrame) -> np.ndarray:
    z = _stack(pdf)
    return z.T @ z


def ridge_path(train: np.ndarray, alpha: float) -> np.ndarray:
    """[intercept, coef] from a cross-product matrix; the intercept is not penalised."""
    n, sx, sy = train[0, 0], train[0, 1:-1], train[0, -1]
    sxx = train[1:-1, 1:-1] - np.outer(sx, sx) / n
    sxy = train[1:-1, -1] - sx * sy / n
    w = np.linalg.solve(sxx + alpha * np.eye(len(sx)), sxy)
    return np.concatenate([[(sy - sx @ w) / n], w])


def ridge_select(train: np.ndarray, val: np.ndarray | None, alphas: Sequence[float]):
    """The alpha with the smallest validation error, read off the validation matrix."""
    usable = val is not None and val[0, 0] > 0
    if usable:
        usable = val[-1, -1] - val[0, -1] ** 2 / val[0, 0] > 0
    if not usable:
        return FALLBACK_ALPHA, ridge_path(train, FALLBACK_ALPHA)
    fits = [(a, ridge_path(train, a)) for a in alphas]

    def error(beta: np.ndarray) -> float:
        v = np.append(beta, -1.0)
        return v @ val @ v

    return min(fits, key=lambda f: error(f[1]))


def _coef_frame(fold, scope, alpha, beta, n) -> pd.DataFrame:
    return pd.DataFrame(
        [{"fold": fold, "scope": scope, "alpha": alpha, "intercept": float(beta[0]),
          "coef": beta[1:].tolist(), "n_train": int(n)}]
    )


MATRIX = T.StructType(
    [
        T.StructField("fold", T.IntegerType()),
        T.StructField("split", T.StringType()),
        T.StructField("salt", T.IntegerType()),
        T.StructField("g", T.ArrayType(T.DoubleType())),
    ]
)


def cross_products(rows: DataFrame) -> DataFrame:
    """Summed [1, x, y] cross products per (fold, split, salt).

    One matrix per fold and split leaves each task; a salted first level keeps any one
    summing group small however many tasks there were.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        salt = 0
        for pdf in batches:
            salt = int(pdf["salt"].iloc[0]) if len(pdf) else salt
            for key, group in pdf.groupby(["fold", "split"]):
                g = _gram(group)
                total[key] = total[key] + g if key in total else g
        for (fold, split), g in total.items():
            yield pd.DataFrame([{"fold": fold, "split": split, "salt": salt, "g": g.ravel().tolist()}])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[[0]][["fold", "split", "salt"]].copy()
        out["g"] = [np.sum(np.stack(pdf["g"].to_numpy()), axis=0).tolist()]
        return out

    salted = rows.withColumn("salt", F.spark_partition_id() % FAN).select("fold", "split", "salt", "x", "y")
    return salted.mapInPandas(partial, MATRIX).groupBy("fold", "split", "salt").applyInPandas(add, MATRIX)


def fit_ridge_pooled(rows: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {s: np.sum(np.stack(g["g"].to_numpy()), axis=0) for s, g in pdf.groupby("split")}
        square = {s: v.reshape(int(round(len(v) ** 0.5)), -1) for s, v in sums.items()}
        if "train" not in square:
            return pd.DataFrame(columns=COEF_SCHEMA.fieldNames())
        alpha, beta = ridge_select(square["train"], square.get("val"), alphas)
        return _coef_frame(pdf["fold"].iloc[0], POOLED, alpha, beta, square["train"][0, 0])

    return cross_products(_fit_rows(rows)).groupBy("fold").applyInPandas(solve, COEF_SCHEMA)


def fit_ridge_per_asset(
    rows: DataFrame, alphas: Sequence[float] = ALPHAS, min_rows: int = MIN_TRAIN_ROWS
) -> DataFrame:
    """One fit per (fold, asset) with enough training rows; the others have no row."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        train, val = pdf[pdf["split"] == "train"], pdf[pdf["split"] == "val"]
        if len(train) < min_rows:
            return pd.DataFrame(columns=COEF_SCHEMA.fieldNames())
        alpha, beta = ridge_select(_gram(train), _gram(val) if len(val) else None, alphas)
        return _coef_frame(pdf["fold"].iloc[0], pdf["asset"].iloc[0], alpha, beta, len(train))

    return _fit_rows(rows).groupBy("fold", "asset").applyInPandas(solve, COEF_SCHEMA)


# -- logistic -----------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def newton_terms(z: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the log-loss over [1, x, y] rows, flattened together."""
    x, y = z[:, :-1], z[:, -1]
    p = _sigmoid(x @ beta)
    grad = x.T @ (p - y)
    hess = (x * (p * (1 - p))[:, None]).T @ x
    return np.concatenate([grad, hess.ravel()])


def newton_step(terms: np.ndarray, beta: np.ndarray, alpha: float) -> np.ndarray:
    k = len(beta)
    penalty = np.full(k, alpha)
    penalty[0] = 0.0
    grad = terms[:k] + penalty * beta
    hess = terms[k:].reshape(k, k) + np.diag(penalty) + 1e-10 * np.eye(k)
    return beta - np.linalg.solve(hess, grad)


def log_loss(z: np.ndarray, beta: np.ndarray) -> float:
    p = np.clip(_sigmoid(z[:, :-1] @ beta), 1e-15, 1 - 1e-15)
    return float(-(z[:, -1] * np.log(p) + (1 - z[:, -1]) * np.log(1 - p)).sum())


STATE = T.StructType(
    [
        T.StructField("fold", T.IntegerType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("salt", T.IntegerType()),
        T.StructField("g", T.ArrayType(T.DoubleType())),
    ]
)


def _reduce(rows: DataFrame, fn, state: dict) -> DataFrame:
    """Sum ``fn(z, beta)`` over all rows of each (fold, alpha) in ``state``."""

    def partial(batches):
        total, salt = {}, 0
        for pdf in batches:
            salt = int(pdf["salt"].iloc[0]) if len(pdf) else salt
            for fold, group in pdf.groupby("fold"):
                z = _stack(group)
                for (f, alpha), beta in state.items():
                    if f == fold:
                        v = np.atleast_1d(fn(z, beta))
                        total[f, alpha] = total[f, alpha] + v if (f, alpha) in total else v
        for (f, alpha), v in total.items():
            yield pd.DataFrame([{"fold": f, "alpha": alpha, "salt": salt, "g": v.tolist()}])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[[0]][["fold", "alpha", "salt"]].copy()
        out["g"] = [np.sum(np.stack(pdf["g"].to_numpy()), axis=0).tolist()]
        return out

    salted = rows.withColumn("salt", F.spark_partition_id() % FAN).select("fold", "salt", "x", "y")
    return salted.mapInPandas(partial, STATE).groupBy("fold", "alpha", "salt").applyInPandas(add, STATE)


def fit_logistic_pooled(
    rows: DataFrame, n_features: int, alphas: Sequence[float] = ALPHAS, tol: float = 1e-8
) -> DataFrame:
    """Newton steps for all folds and penalties together, one Spark job per step.

    Only the coefficient vectors (folds x penalties x features) travel to the driver;
    ``rows`` should be materialised, as every step reads it.
    """
    spark = rows.sparkSession
    train = _fit_rows(rows.filter("split = 'train'"))
    val = _fit_rows(rows.filter("split = 'val'"))
    sizes = lambda part: {
        r["fold"]: r["n"]
        for r in part.groupBy("fold")
        .agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))
        .filter("low < high")
        .collect()
    }
    counts, graded = sizes(train), sizes(val)  # folds whose slice has both classes
    if not counts:
        return spark.createDataFrame([], COEF_SCHEMA)
    train = train.filter(F.col("fold").isin(list(counts)))
    val = val.filter(F.col("fold").isin([f for f in graded if f in counts]))
    state = {(f, a): np.zeros(n_features + 1) for f in counts for a in alphas}

    for left in range(NEWTON_STEPS, 0, -1):
        current = state

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            key = (pdf["fold"].iloc[0], pdf["alpha"].iloc[0])
            terms = np.sum(np.stack(pdf["g"].to_numpy()), axis=0)
            out = pdf.iloc[[0]][["fold", "alpha", "salt"]].copy()
            out["g"] = [newton_step(terms, current[key], key[1]).tolist()]
            return out

        moved = _reduce(train, newton_terms, state).groupBy("fold", "alpha").applyInPandas(step, STATE)
        state = {(r["fold"], r["alpha"]): np.array(r["g"]) for r in moved.collect()}
        if max(np.abs(state[k] - current[k]).max() for k in state) < tol:
            break
        if left == 1:
            raise RuntimeError(f"the logistic fit did not settle in {NEWTON_STEPS} steps")
    losses: dict[int, dict[float, float]] = {}
    scored = _reduce(val, log_loss, state).groupBy("fold", "alpha").agg(F.sum(F.get("g", F.lit(0))).alias("loss"))
    for r in scored.collect():
        losses.setdefault(r["fold"], {})[r["alpha"]] = r["loss"]
    out = []
    for fold, n in counts.items():
        alpha = min(losses[fold], key=losses[fold].get) if fold in losses else FALLBACK_ALPHA
        beta = state[fold, alpha]
        out.append((fold, POOLED, alpha, float(beta[0]), beta[1:].tolist(), n))
    return spark.createDataFrame(out, COEF_SCHEMA)


def fit_logistic_per_asset(
    rows: DataFrame, alphas: Sequence[float] = ALPHAS, min_rows: int = MIN_TRAIN_ROWS
) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        train, val = pdf[pdf["split"] == "train"], pdf[pdf["split"] == "val"]
        if len(train) < min_rows or train["y"].nunique() < 2:
            return pd.DataFrame(columns=COEF_SCHEMA.fieldNames())
        z, fits = _stack(train), {}
        for alpha in alphas:
            beta = np.zeros(z.shape[1] - 1)
            for _ in range(NEWTON_STEPS):
                old, beta = beta, newton_step(newton_terms(z, beta), beta, alpha)
                if np.abs(beta - old).max() < 1e-8:
                    break
            else:
                raise RuntimeError(f"the logistic fit did not settle in {NEWTON_STEPS} steps")
            fits[alpha] = beta
        best = FALLBACK_ALPHA
        if val["y"].nunique() > 1:
            zv = _stack(val)
            best = min(fits, key=lambda a: log_loss(zv, fits[a]))
        return _coef_frame(pdf["fold"].iloc[0], pdf["asset"].iloc[0], best, fits[best], len(train))

    return _fit_rows(rows).groupBy("fold", "asset").applyInPandas(solve, COEF_SCHEMA)


# -- prediction ---------------------------------------------------------------------


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def predict(rows: DataFrame, coefs: DataFrame, model: str, target: str, logistic: bool = False) -> DataFrame:
    """Predictions on test rows; a scope without a fit leaves NULL forecasts.

    Pooled coefficients are one row per fold and are broadcast; per-asset ones join on
    (fold, asset).
    """
    test = rows.filter(F.col("split") == "test")
    pooled = not model.endswith(SUFFIX)
    if pooled:
        joined = test.join(F.broadcast(coefs.drop("scope")), "fold", "left")
    else:
        joined = test.join(coefs.withColumnRenamed("scope", "asset"), ["fold", "asset"], "left")
    z = F.col("intercept") + dot(F.col("x"), F.col("coef"))
    proba = 1 / (1 + F.exp(-z)) if logistic else F.lit(None)
    pred = F.when(z.isNotNull(), (z >= 0).cast("double")) if logistic else z
    return joined.select(
        "asset", "date", pred.alias("pred"), proba.cast("double").alias("proba"),
        F.lit(model).alias("model"), "fold", F.lit(None).cast("int").alias("seed"),
        F.lit(target).alias("target"), F.col("y").alias("y_true"),
    )


def coefficients(coefs: DataFrame, columns: Sequence[str], model: str) -> DataFrame:
    """Signed coefficients, one row per (fold, scope, feature)."""
    names = F.array(*[F.lit(c) for c in columns])
    pair = F.explode(F.arrays_zip(names.alias("feature"), F.col("coef").alias("coef")))
    return coefs.select(F.lit(model).alias("model"), "fold", "scope", pair.alias("_c")).select(
        "model", "fold", "scope", "_c.feature", "_c.coef"
    )


def importance(coefs: DataFrame, columns: Sequence[str], model: str) -> DataFrame:
    """|coefficient| per feature and fold, averaged over the scopes of a fold."""
    return coefficients(coefs, columns, model).groupBy("model", "fold", "feature").agg(
        F.avg(F.abs("coef")).alias("gain")
    )


def skipped_scopes(rows: DataFrame, min_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Training rows of every (fold, asset) scope and whether it is large enough to fit."""
    n = F.sum(((F.col("split") == "train") & F.col("y").isNotNull()).cast("bigint"))
    return rows.groupBy("fold", "asset").agg(n.alias("n_train")).withColumn(
        "fitted", F.col("n_train") >= min_rows
    )


def target_scale(membership: DataFrame, target: str) -> DataFrame:
    """Training mean and population spread of a target per fold (spread 1 if constant)."""
    sd = F.stddev_pop(target)
    return membership.filter("split = 'train'").groupBy("fold").agg(
        F.avg(target).alias("y_mean"), F.when(sd > 1e-12, sd).otherwise(1.0).alias("y_sd")
    )
