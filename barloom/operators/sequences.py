"""Lookback windows as arrays, and their trend/seasonal decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import Series


def sequence_windows(
    df: DataFrame, columns: Sequence[str], lookback: int = 30, keys: Sequence[str] = ("asset",)
) -> DataFrame:
    """Add ``window``: the last ``lookback`` rows x features, zero-padded on the left."""
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    history = F.collect_list("_x").over(Series(keys).frame(lookback))
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(columns)), F.lit(lookback) - F.size("_h"))
    return (
        df.withColumn("_x", row).withColumn("_h", history)
        .withColumn("window", F.concat(zeros, F.col("_h"))).drop("_x", "_h")
    )


def asset_codes(membership: DataFrame) -> DataFrame:
    """(fold, asset, code): position among the fold's training assets."""
    seen = membership.filter("split = 'train'").select("fold", "asset").distinct()
    w = Window.partitionBy("fold").orderBy("asset")
    return seen.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def with_asset_code(membership: DataFrame) -> DataFrame:
    """Attach the code; an asset unseen in training gets the slot after the last one."""
    codes = asset_codes(membership)
    sizes = codes.groupBy("fold").agg(F.count(F.lit(1)).cast("int").alias("_unknown"))
    out = membership.join(codes, ["fold", "asset"], "left").join(F.broadcast(sizes), "fold", "left")
    return out.withColumn("asset_code", F.coalesce("code", "_unknown")).drop("code", "_unknown")


def trend(values: Column, length: int, kernel: int = 7) -> Column:
    """Centred moving average of an array, edges repeated, inside the array only."""
    half = (kernel - 1) // 2
    last = length - 1

    def at(i: Column) -> Column:
        steps = F.sequence(i - half, i + (kernel - 1 - half))
        total = F.aggregate(
            steps, F.lit(0.0), lambda acc, j: acc + F.get(values, F.least(F.greatest(j, F.lit(0)), F.lit(last)))
        )
        return total / kernel

    return F.transform(F.sequence(F.lit(0), F.lit(last)), at)


def _feature(window: str, k: int) -> Column:
    return F.transform(window, lambda row: F.get(row, F.lit(k)))


def decompose(df: DataFrame, n_features: int, lookback: int, kernel: int = 7) -> DataFrame:
    """Add ``trend`` and ``seasonal``: feature-major arrays of the window."""
    df = df.withColumns({f"_s{k}": _feature("window", k) for k in range(n_features)})
    df = df.withColumns({f"_t{k}": trend(F.col(f"_s{k}"), lookback, kernel) for k in range(n_features)})
    trends = F.concat(*[F.col(f"_t{k}") for k in range(n_features)])
    rest = F.concat(
        *[F.zip_with(f"_s{k}", f"_t{k}", lambda a, b: a - b) for k in range(n_features)]
    )
    scratch = [f"_{p}{k}" for p in "st" for k in range(n_features)]
    return df.withColumn("trend", trends).withColumn("seasonal", rest).drop(*scratch)


def window_design(
    membership: DataFrame, columns: Sequence[str], target: str,
    lookback: int = 30, kernel: int = 7, n_assets: int | None = None,
) -> DataFrame:
    """Rows for a linear map of the decomposed window plus a per-asset offset.

    Two stacked linear layers without a nonlinearity are one linear model, so the
    window forecaster is :mod:`barloom.operators.linear` on this design.  ``n_assets`` is
    the number of asset codes, counted from the rows where it is not given.
    """
    if n_assets is None:
        n_assets = (asset_codes(membership).agg(F.max("code")).first()[0] or 0) + 1
    df = with_asset_code(sequence_windows(membership, columns, lookback, ("fold", "asset")))
    df = decompose(df, len(columns), lookback, kernel)
    offsets = F.array(*[(F.col("asset_code") == k).cast("double") for k in range(n_assets)])
    x = F.concat("trend", "seasonal", offsets)
    return df.select("fold", "split", "asset", "date", x.alias("x"), F.col(target).alias("y"))
