"""The feature matrix: enabled families plus targets and meta columns, one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import Series
from barloom.operators import auxiliary, cross_asset, features
from barloom.operators.targets import add_meta, add_targets
from barloom.schema import FAMILIES

BUILDERS = {
    "price": features.add_price,
    "volume": features.add_volume,
    "range_vol": features.add_range_vol,
    "technical": features.add_technical,
    "calendar": features.add_calendar,
}


def family_of(column: str) -> str | None:
    for prefix, family in FAMILIES.items():
        if column.startswith(prefix):
            return family
    return None


def feature_columns(df: DataFrame) -> list[str]:
    """Feature columns by prefix; ``vol_1d`` is a target, not a volume feature."""
    return [c for c in df.columns if family_of(c) and c != "vol_1d"]


def build_features(
    panel: DataFrame,
    families: Sequence[str] = tuple(BUILDERS),
    *,
    reference: str | None = None,
    sentiment: DataFrame | None = None,
    onchain: DataFrame | None = None,
    onchain_metrics: Sequence[str] = (),
    macro: DataFrame | None = None,
    macro_series: Sequence[str] = (),
) -> DataFrame:
    """Add every enabled family; absent auxiliary sources add no column.

    Cross-sectional and auxiliary blocks come first: they need joins by date, after
    which all per-asset windows share the one exchange by asset.  Pass a frozen panel
    (read back from storage or checkpointed): several blocks read it.
    """
    df = panel
    # One calendar of the bare panel serves every block.
    calendar = cross_asset.date_calendar(panel)
    if "cross_asset" in families:
        df = cross_asset.add_cross_asset(df, reference, calendar)
    if "auxiliary" in families:
        if sentiment is not None:
            df = auxiliary.add_sentiment(df, sentiment, calendar)
        if macro is not None and macro_series:
            df = auxiliary.add_macro(df, macro, macro_series, calendar)
        if onchain is not None and onchain_metrics:
            df = auxiliary.add_onchain(df, onchain, onchain_metrics)
    for name in families:
        if name in BUILDERS:
            df = BUILDERS[name](df)
    names = feature_columns(df)
    if len(names) != len(set(names)):
        raise ValueError("duplicate feature names")
    return df


def build_matrix(panel: DataFrame, families=tuple(BUILDERS), **aux) -> DataFrame:
    return add_targets(add_meta(build_features(panel, families, **aux)))


def drop_warmup(matrix: DataFrame, warmup: int, primary: str) -> DataFrame:
    """Drop each asset's first ``warmup`` rows and rows without the primary target."""
    return (
        matrix.withColumn("_i", Series().number())
        .filter((F.col("_i") >= warmup) & F.col(primary).isNotNull())
        .drop("_i")
    )


def safe_meta(df: DataFrame) -> DataFrame:
    """Meta columns with everything forward-looking removed."""
    unsafe = [
        c for c in df.columns
        if c in ("ret_1d", "dir_1d", "vol_1d") or c.startswith(("fwd_", "realised_var_1d"))
    ]
    return df.drop(*unsafe)


def family_summary(df: DataFrame) -> DataFrame:
    """Features and non-null values per family and in total, from one pass over the rows."""
    names = feature_columns(df)
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    cells = [
        F.struct(F.lit(f).alias("family"), F.col(c).alias("n_values")) for c in names for f in (family_of(c), "TOTAL")
    ]
    return (
        counts.select(F.explode(F.array(*cells)).alias("_c")).groupBy("_c.family")
        .agg(F.count(F.lit(1)).alias("n_features"), F.sum("_c.n_values").alias("n_values"))
    )
