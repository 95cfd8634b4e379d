"""``xa_``: cross-sectional features on the calendar of dates present in the panel.

"Previous date" here is the previous date any asset traded.  Instead of building the
dense date x asset grid, every distinct date gets an ordinal; a row's cross-sectional
neighbour is the row at ordinal - 1, and an asset that skipped that date has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import by_date
from barloom.functions.rolling import add_rolling
from barloom.functions.series import Series

REF_CORR_WINDOWS = (30, 90)
STRENGTH_WINDOWS = (7, 30)


def date_calendar(panel: DataFrame) -> DataFrame:
    """Distinct panel dates with a 0-based ordinal (one row per date)."""
    days = panel.select("date").distinct()
    return days.withColumn("_di", calendar_series().number())


def calendar_series() -> Series:
    """Window over a one-row-per-date table; constant key, bounded by the calendar."""
    return Series(keys=[F.lit(0)])


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties averaged, as a fraction of the non-null values."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    n = F.count(value).over(Window.partitionBy(*keys))
    nulls = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - n
    # NULLs sort first, so they are taken off the rank of every real value.
    rank = F.rank().over(w) - nulls
    return F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2.0) / n)


def with_returns(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Panel rows with date ordinal and one-row log return."""
    df = panel.withColumn("_r1", Series().diff(F.ln("close")))
    return df.join(by_date(calendar), "date")


def by_date_join(dates: DataFrame, values: DataFrame) -> DataFrame:
    return dates.join(by_date(values), "date", "left")


def reference_by_date(returns: DataFrame, calendar: DataFrame, reference: str) -> DataFrame:
    """The reference asset's return and its lagged statistics, one row per date."""
    cal = calendar_series()
    ref = returns.filter(F.col("asset") == reference).select("date", F.col("_r1").alias("_ref"))
    ref = by_date_join(calendar, ref).withColumn("_ref1", cal.lag("_ref"))
    c = {
        "xa_ref_ret_lag1": F.col("_ref1"),
        "xa_ref_ret_lag2": cal.lag("_ref", 2),
        "xa_ref_ret_mean_5": cal.mean("_ref1", 5),
        "xa_ref_vol_21": cal.std("_ref1", 21),
    }
    for n in STRENGTH_WINDOWS:
        c[f"_ref_sum_{n}"] = cal.sum("_ref", n)
    return ref.withColumns(c).drop("_ref1", "_di")


def market_by_date(returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean and dispersion of the previous calendar date's returns, one row per date."""
    cal = calendar_series()
    market = returns.groupBy("_di").agg(
        F.avg("_r1").alias("_m"), F.stddev_samp("_r1").alias("_sd")
    )
    # Attach each date's cross-section to the following date of the calendar.
    shifted = market.select((F.col("_di") + 1).alias("_di"), "_m", "_sd")
    return calendar.join(shifted, "_di", "left").select(
        "date",
        F.col("_m").alias("xa_market_ret_lag1"),
        cal.mean("_m", 5).alias("xa_market_ret_mean_5"),
        F.col("_sd").alias("xa_market_dispersion"),
    )


def _add_reference_columns(df: DataFrame) -> DataFrame:
    s = Series()
    rolls = {f"_corr_{n}": ("corr", ("_r1", "_ref"), n) for n in REF_CORR_WINDOWS}
    rolls |= {f"_own_{n}": ("sum", "_r1", n) for n in STRENGTH_WINDOWS}
    df = add_rolling(df, s, rolls)
    c = {}
    for n in REF_CORR_WINDOWS:
        # The last n rows must be n consecutive calendar ordinals.
        dense = F.col("_di") - s.lag("_di", n - 1) == n - 1
        c[f"xa_corr_ref_{n}"] = F.when(dense, F.col(f"_corr_{n}"))
    for n in STRENGTH_WINDOWS:
        c[f"xa_rel_strength_{n}"] = F.col(f"_own_{n}") - F.col(f"_ref_sum_{n}")
    return df.withColumns(c)


def _section_columns() -> dict[str, Column]:
    s = Series()
    previous = s.lag("_di") == F.col("_di") - 1
    return {
        "xa_rank_ret_lag1": F.when(previous, s.lag("_rank")),
        "xa_excess_ret_lag1": F.when(previous, s.lag("_r1")) - F.col("xa_market_ret_lag1"),
    }


def _finish(df: DataFrame, panel: DataFrame) -> DataFrame:
    scratch = [c for c in df.columns if c.startswith("_") and c not in panel.columns]
    return df.drop(*scratch)


def add_reference(
    panel: DataFrame, reference: str, calendar: DataFrame | None = None
) -> DataFrame:
    """Lead-lag features against one reference asset."""
    calendar = calendar if calendar is not None else date_calendar(panel)
    df = with_returns(panel, calendar)
    df = df.join(by_date(reference_by_date(df, calendar, reference)), "date", "left")
    return _finish(_add_reference_columns(df), panel)


def add_cross_section(panel: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Rank, market mean, dispersion and excess of the previous date's returns."""
    calendar = calendar if calendar is not None else date_calendar(panel)
    df = with_returns(panel, calendar)
    market = market_by_date(df, calendar)
    df = df.withColumn("_rank", average_rank("_r1", ["_di"]))
    df = df.join(by_date(market), "date", "left")
    return _finish(df.withColumns(_section_columns()), panel)


def has_asset(panel: DataFrame, asset: str) -> bool:
    return not panel.filter(F.col("asset") == asset).limit(1).isEmpty()


def add_cross_asset(
    panel: DataFrame, reference: str | None, calendar: DataFrame | None = None
) -> DataFrame:
    """Both blocks; without a reference asset only the cross-section."""
    calendar = calendar if calendar is not None else date_calendar(panel)
    if not reference:
        return add_cross_section(panel, calendar)
    base = with_returns(panel, calendar)
    market = market_by_date(base, calendar)
    ref = reference_by_date(base, calendar, reference)
    df = base.withColumn("_rank", average_rank("_r1", ["_di"]))
    df = df.join(by_date(ref), "date", "left").join(by_date(market), "date", "left")
    return _finish(_add_reference_columns(df.withColumns(_section_columns())), panel)
