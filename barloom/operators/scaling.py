"""Fold-local winsorising and scaling, learned on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import finite
from barloom.operators.quantiles import exact_quantiles


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value) rows."""
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")


def fit_scaler(
    membership: DataFrame,
    columns: Sequence[str],
    lower_q: float = 0.01,
    upper_q: float = 0.99,
    winsorize: bool = True,
) -> DataFrame:
    """(fold, feature) -> lo, hi, median, mean, sd over the fold's training rows.

    One quantile pass serves the clip bounds and the median: clipping leaves the middle
    order statistics where they are.
    """
    train = membership.filter(F.col("split") == "train").select("fold", *columns)
    long = unpivot(train, ["fold"], columns)
    q = exact_quantiles(long, ["fold", "feature"], "value", [lower_q, 0.5, upper_q])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("q")))
    bounds = q.groupBy("fold", "feature").agg(
        at(lower_q).alias("lo"), at(upper_q).alias("hi"), at(0.5).alias("median")
    )
    if not winsorize:
        nothing = F.lit(None).cast("double")
        bounds = bounds.withColumn("lo", nothing).withColumn("hi", nothing)
    # One row per fold and feature: bounded by the calendar times the schema.
    clipped = long.join(F.broadcast(bounds), ["fold", "feature"]).withColumn(
        "value", clip(F.col("value"), F.col("lo"), F.col("hi"))
    )
    moments = clipped.groupBy("fold", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
    )
    every = membership.select("fold").distinct().select(
        "fold", F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature")
    )
    return (
        every.join(bounds, ["fold", "feature"], "left")
        .join(moments, ["fold", "feature"], "left")
        .withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    )


def clip(v: Column, lo: Column, hi: Column) -> Column:
    """Clip that keeps NULL; a NULL bound does not bind."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def transform(
    membership: DataFrame, stats: DataFrame, columns: Sequence[str], standardize: bool = True
) -> DataFrame:
    """Apply learned statistics; anything still missing becomes zero."""
    missing = set(columns) - set(membership.columns)
    if missing:
        raise ValueError(f"columns learned at fit time are absent: {sorted(missing)}")
    # One row per fold: the statistics of column i are element i of the array.
    place = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    entry = F.struct(place[F.col("feature")].alias("i"), "lo", "hi", "median", "mean", "sd")
    packed = stats.filter(F.col("feature").isin(*columns)).groupBy("fold").agg(
        F.sort_array(F.collect_list(entry)).alias("_stats")
    )
    df = membership.join(F.broadcast(packed), "fold")
    out = {}
    for i, c in enumerate(columns):
        s = F.get("_stats", F.lit(i))
        v = F.coalesce(clip(F.col(c).cast("double"), s["lo"], s["hi"]), s["median"])
        if standardize:
            v = (v - s["mean"]) / s["sd"]
        out[c] = F.coalesce(finite(v), F.lit(0.0))
    return df.withColumns(out).drop("_stats")
