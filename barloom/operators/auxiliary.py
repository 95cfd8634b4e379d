"""``aux_``: sentiment, on-chain and macro series, each published one panel date late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import by_date, floor_at
from barloom.functions.series import Series
from barloom.operators.cross_asset import by_date_join, calendar_series, date_calendar

LEVEL_SERIES = "vixcls"


def add_sentiment(
    panel: DataFrame, sentiment: DataFrame, calendar: DataFrame | None = None
) -> DataFrame:
    """Level, 7-date change and 63-date z-score of a market-wide daily index.

    ``sentiment`` holds one row per date (see ``sources.auxiliary.read_sentiment``).
    """
    cal = calendar_series()
    calendar = calendar if calendar is not None else date_calendar(panel)
    days = by_date_join(calendar, sentiment.select("date", "fng"))
    days = days.withColumn("aux_fng", cal.lag("fng")).select(
        "date",
        "aux_fng",
        cal.diff("aux_fng", 7).alias("aux_fng_chg_7"),
        cal.zscore("aux_fng", 63).alias("aux_fng_z_63"),
    )
    return panel.join(by_date(days), "date", "left")


def add_onchain(panel: DataFrame, onchain: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per asset and metric: 63-row z-score (21 suffice) and 7-row change of the log."""
    s = Series()
    df = panel.join(onchain.select("asset", "date", *metrics), ["asset", "date"], "left")
    df = df.withColumns({f"_l_{m}": F.log1p(floor_at(s.lag(m), 0.0)) for m in metrics})
    c = {}
    for m in metrics:
        c[f"aux_{m.lower()}_z63"] = s.zscore(f"_l_{m}", 63, min_periods=21)
        c[f"aux_{m.lower()}_chg_7"] = s.diff(f"_l_{m}", 7)
    return df.withColumns(c).drop(*metrics, *[f"_l_{m}" for m in metrics])


def matched_metrics(panel: DataFrame, onchain: DataFrame, metrics: Sequence[str]) -> list[str]:
    """Metrics that match the panel at least once (one aggregate row)."""
    joined = panel.select("asset", "date").join(onchain, ["asset", "date"])
    row = joined.agg(*[F.count(m).alias(m) for m in metrics]).first()
    return [m for m in metrics if row[m]]


def add_macro(
    panel: DataFrame, macro: DataFrame, series: Sequence[str], calendar: DataFrame | None = None
) -> DataFrame:
    """Forward-filled macro levels; the volatility index as a level, others differenced."""
    cal = calendar_series()
    calendar = calendar if calendar is not None else date_calendar(panel)
    days = by_date_join(calendar, macro.select("date", *series))
    days = days.withColumns({f"_f_{n}": cal.fill_forward(n) for n in series})
    days = days.withColumns({f"_x_{n}": cal.lag(f"_f_{n}") for n in series})
    c = []
    for n in series:
        name = n.lower()
        if name == LEVEL_SERIES:
            c.append(F.col(f"_x_{n}").alias(f"aux_{name}"))
            steps = (5,)
        else:
            steps = (1, 21)
        c += [cal.diff(f"_x_{n}", k).alias(f"aux_{name}_chg_{k}") for k in steps]
    return panel.join(by_date(days.select("date", *c)), "date", "left")
