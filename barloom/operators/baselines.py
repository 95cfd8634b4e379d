"""Baseline forecasters over fold membership.

Each reads (fold, split, asset, date, ret_lag1, realised_var_now, target columns) and
returns the prediction relation.  Training statistics are one row per fold; everything
else is a window within (fold, asset).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import floor_at, positive_ln
from barloom.functions.normal import normal_cdf
from barloom.functions.series import Series
from barloom.operators.ewm import add_ewm
from barloom.operators.quantiles import exact_quantiles
from barloom.schema import PREDICTION_COLUMNS

DIRECTION, RETURN, VOLATILITY = "dir_1d", "ret_1d", "vol_1d"

# Fixed values.
MEAN_WINDOW = 63
MEAN_MIN = 5
VOL_MIN = 10
EWMA_LAMBDA = 0.94
EWMA_TAIL = 250
VARIANCE_FLOOR = 1e-12
SIGMA_DEFAULT = 1e-2

BASELINES = {
    RETURN: ("zero", "persistence", "historical_mean"),
    DIRECTION: ("zero", "persistence", "historical_mean", "majority_class"),
    VOLATILITY: ("vol_persistence", "vol_climatology", "vol_trailing_mean", "vol_ewma"),
}

PER_FOLD_ASSET = Series(keys=("fold", "asset"))


def proba_from_forecast(forecast: Column, sigma: Column) -> Column:
    """P(up) of a point forecast under normal errors of spread ``sigma``."""
    return normal_cdf(forecast / F.when(sigma > 0, sigma).otherwise(1e-6))


def as_predictions(df: DataFrame, model: str, target: str, pred: Column, proba: Column | None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "asset", "date",
        pred.cast("double").alias("pred"),
        (none if proba is None else proba).cast("double").alias("proba"),
        F.lit(model).alias("model"),
        "fold",
        none.cast("int").alias("seed"),
        F.lit(target).alias("target"),
        F.col(target).alias("y_true"),
    ).select(*PREDICTION_COLUMNS)


def _train(membership: DataFrame) -> DataFrame:
    return membership.filter(F.col("split") == "train")


def _test(membership: DataFrame) -> DataFrame:
    return membership.filter(F.col("split") == "test")


def return_stats(membership: DataFrame, target: str) -> DataFrame:
    """Per fold: pooled training spread and mean of returns, and the base rate."""
    spread = F.stddev_samp("ret_lag1")
    return _train(membership).groupBy("fold").agg(
        F.when(spread > 0, spread).otherwise(SIGMA_DEFAULT).alias("_sigma"),
        F.coalesce(F.avg("ret_lag1"), F.lit(0.0)).alias("_mean"),
        F.coalesce(F.avg(target), F.lit(0.5)).alias("_rate"),
    )


def return_baselines(membership: DataFrame, target: str, names=None) -> DataFrame:
    """``zero``, ``persistence``, ``historical_mean`` and ``majority_class`` together.

    All of them are column expressions on the test rows joined to the per-fold training
    statistics, so one scan and one window produce every model.
    """
    names = names or BASELINES[target]
    direction = target == DIRECTION
    df = _test(membership).join(F.broadcast(return_stats(membership, target)), "fold")
    df = df.withColumn("_last", F.coalesce("ret_lag1", F.lit(0.0)))
    # The trailing window sees the fold's own test rows only.
    if "historical_mean" in names:
        trailing = PER_FOLD_ASSET.mean("ret_lag1", MEAN_WINDOW, MEAN_MIN)
        df = df.withColumn("_trail", F.coalesce(trailing, F.col("_mean")))
    up = lambda c: (c > 0).cast("double") if direction else c
    sigma = F.col("_sigma")
    forms = {
        "zero": lambda: (F.lit(0.5 if direction else 0.0), F.lit(0.5)),
        "persistence": lambda: (up(F.col("_last")), proba_from_forecast(F.col("_last"), sigma)),
        "historical_mean": lambda: (
            up(F.col("_trail")),
            proba_from_forecast(F.col("_trail"), sigma / math.sqrt(MEAN_WINDOW)),
        ),
        "majority_class": lambda: ((F.col("_rate") >= 0.5).cast("double"), F.col("_rate")),
    }
    models = []
    for n in names:
        pred, proba = forms[n]()
        models.append(
            F.struct(
                F.lit(n).alias("model"),
                pred.cast("double").alias("pred"),
                (proba if direction else F.lit(None)).cast("double").alias("proba"),
            )
        )
    long = df.withColumn("_m", F.explode(F.array(*models)))
    return long.select(
        "asset", "date", "_m.pred", "_m.proba", "_m.model", "fold",
        F.lit(None).cast("int").alias("seed"), F.lit(target).alias("target"),
        F.col(target).alias("y_true"),
    )


def _levels(df: DataFrame) -> DataFrame:
    """Realised variance with zero treated as missing, and its log."""
    v = F.when(F.col("realised_var_now") > 0, F.col("realised_var_now"))
    return df.withColumn("_v", v).withColumn("_lv", positive_ln(v))


def volatility_baselines(
    membership: DataFrame, names=None, include_val: bool = False, ewma_tail: int = EWMA_TAIL
) -> DataFrame:
    """The four log-variance baselines together; the ones in ``names`` are returned.

    * ``vol_persistence``: today's log variance, the training median where it is missing.
    * ``vol_climatology``: trailing mean of logs over the fold's own test rows.
    * ``vol_trailing_mean``: trailing arithmetic mean, warmed up on the rows before the test.
    * ``vol_ewma``: exponentially weighted variance; a missing row keeps the previous state.
      Its state starts ``ewma_tail`` history rows before the test, which is part of the
      forecast's definition.

    One table of test rows with their preceding history carries all four as columns; pass
    a materialised membership, since the training statistics read it too.
    """
    names = names or BASELINES[VOLATILITY]
    history = ("train", "val") if include_val else ("train",)
    is_test, is_train, past = F.col("split") == "test", F.col("split") == "train", F.col("split").isin(*history)
    df = _levels(membership)
    # One row per fold: bounded by the calendar.
    stats = df.groupBy("fold").agg(
        F.avg(F.when(is_train, F.col("_lv"))).alias("_mean"),
        F.ln(F.avg(F.when(past, F.col("_v")))).alias("_level"),
    )
    if "vol_persistence" in names:
        median = exact_quantiles(df.filter(is_train), ["fold"], "_lv", [0.5])
        stats = stats.join(F.broadcast(median.select("fold", F.col("q").alias("_median"))), "fold", "left")
    if not {"vol_trailing_mean", "vol_ewma"} & set(names):
        rows = df.filter(is_test).withColumn("_test", F.lit(True))
    else:
        back = Window.partitionBy("fold", "asset", "_test").orderBy(F.desc("date"))
        rows = (
            df.filter(is_test | past)
            .withColumn("_test", is_test)
            .repartition("fold", "asset")  # serves every window below
            .withColumn("_back", F.row_number().over(back))
            .filter(F.col("_test") | (F.col("_back") <= max(MEAN_WINDOW, ewma_tail)))
        )
    if "vol_climatology" in names:
        own = Series(keys=("fold", "asset", "_test"))
        rows = rows.withColumn("_clim", own.mean("_lv", MEAN_WINDOW, VOL_MIN))
    if "vol_trailing_mean" in names:
        rows = rows.withColumn("_trail", PER_FOLD_ASSET.mean("_v", MEAN_WINDOW, VOL_MIN))
    if "vol_ewma" in names:
        seen = F.when(F.col("_test") | (F.col("_back") <= ewma_tail), F.col("_v"))
        rows = rows.withColumn("_seen", seen).withColumn("_null", F.col("_seen").isNull())
        rows = add_ewm(rows, {"_e": ("_seen", 1 - EWMA_LAMBDA)}, Series(keys=("fold", "asset", "_null")))
        rows = rows.withColumn("_ewma", PER_FOLD_ASSET.fill_forward("_e"))
    logs = lambda c: F.ln(floor_at(c, VARIANCE_FLOOR))
    forms = {
        "vol_persistence": lambda: (F.col("_lv"), F.col("_median")),
        "vol_climatology": lambda: (F.col("_clim"), F.col("_mean")),
        "vol_trailing_mean": lambda: (logs("_trail"), F.col("_level")),
        "vol_ewma": lambda: (logs("_ewma"), F.col("_level")),
    }
    cells = [
        F.struct(F.lit(n).alias("model"), F.coalesce(*forms[n](), F.lit(0.0)).alias("pred")) for n in names
    ]
    out = rows.filter("_test").join(F.broadcast(stats), "fold", "left")
    return out.withColumn("_m", F.explode(F.array(*cells))).select(
        "asset", "date", F.col("_m.pred").cast("double").alias("pred"), F.lit(None).cast("double").alias("proba"),
        "_m.model", "fold", F.lit(None).cast("int").alias("seed"), F.lit(VOLATILITY).alias("target"),
        F.col(VOLATILITY).alias("y_true"),
    )


def vol_persistence(membership: DataFrame) -> DataFrame:
    return volatility_baselines(membership, ("vol_persistence",))


def vol_climatology(membership: DataFrame) -> DataFrame:
    return volatility_baselines(membership, ("vol_climatology",))


def vol_trailing_mean(membership: DataFrame, include_val: bool = False) -> DataFrame:
    return volatility_baselines(membership, ("vol_trailing_mean",), include_val)


def vol_ewma(membership: DataFrame, include_val: bool = False, tail: int = EWMA_TAIL) -> DataFrame:
    return volatility_baselines(membership, ("vol_ewma",), include_val, tail)


def baselines_for(membership: DataFrame, target: str) -> DataFrame:
    """Predictions of every baseline that applies to ``target``."""
    if target == VOLATILITY:
        return volatility_baselines(membership)
    return return_baselines(membership, target)
