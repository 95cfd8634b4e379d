"""Cost-aware portfolio accounting as window and group-by steps.

``run`` names the columns that identify one book (model, say, or model and asset).
Positions decided on a date earn that date's forward return; nothing is shifted here.
Costs only scale turnover, so every cost level is computed on the small date-level table
rather than on another copy of the book.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import finite
from barloom.functions.series import Series
from barloom.operators.compare import seed_averaged

PERIODS_PER_YEAR = 365
COST_LEVELS = (0.0, 5.0, 20.0)


@dataclass(frozen=True)
class CostModel:
    """Cost of one unit of turnover: half a round-trip commission plus slippage."""

    commission_bps: float = 10.0
    slippage_bps: float = 5.0

    @classmethod
    def from_round_trip_bps(cls, bps: float) -> CostModel:
        return cls(commission_bps=bps, slippage_bps=0.0)

    @property
    def rate(self) -> float:
        return (self.commission_bps / 2 + self.slippage_bps) / 1e4


def signal_to_position(p: Column, rule: str = "long_short", threshold=0.5, band=0.02) -> Column:
    """Probability of an up move -> target position; a missing one is flat."""
    if rule == "long_only":
        return F.when(p > threshold, 1.0).otherwise(0.0)
    if rule == "long_short":
        return F.when(p > 0.5 + band, 1.0).when(p < 0.5 - band, -1.0).otherwise(0.0)
    raise ValueError(f"unknown rule {rule!r}")


def positions_for(predictions: DataFrame, column: str = "proba", **rule) -> DataFrame:
    """Seed-averaged positions; keys without any forecast stay as flat days."""
    signal = seed_averaged(predictions, column, keep_empty=True)
    return signal.select(
        "model", "asset", "date", signal_to_position(F.col("signal"), **rule).alias("position")
    )


def with_forward_returns(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """Attach the realised next-day simple return of the frozen panel."""
    fwd = targets.select("asset", "date", F.col("fwd_ret_simple").alias("forward_return"))
    return positions.join(fwd, ["asset", "date"], "left")


def dropped_rows(positions: DataFrame, run: Sequence[str]) -> DataFrame:
    missing = finite("forward_return").isNull().cast("bigint")
    return positions.groupBy(*run).agg(F.sum(missing).alias("n_rows_dropped"))


def book(positions: DataFrame, run: Sequence[str], cost: CostModel | None = None) -> DataFrame:
    """Per (run, asset, date): own turnover, equal weight over active assets, its turnover.

    Rows without a forward return are dropped first; a missing position is flat.
    """
    run = list(run)
    rows = positions.withColumn("forward_return", finite("forward_return")).filter(
        "forward_return is not null"
    )
    rows = rows.withColumn("position", F.coalesce("position", F.lit(0.0)))
    active = F.sum((F.col("position") != 0).cast("bigint")).over(Window.partitionBy(*run, "date"))
    rows = rows.withColumn("n_active", active).withColumn(
        "weight", F.coalesce(F.try_divide(F.col("position"), F.col("n_active")), F.lit(0.0))
    )
    own = Series(keys=[*run, "asset"] if "asset" not in run else run)
    move = lambda c: F.abs(F.col(c) - F.coalesce(own.lag(c), F.lit(0.0)))
    out = rows.withColumns(
        {
            "turnover": move("position"),
            "weight_turnover": move("weight"),
            "gross": F.col("position") * F.col("forward_return"),
        }
    )
    if cost is not None:
        out = out.withColumn("cost", F.col("turnover") * cost.rate)
        out = out.withColumn("net", F.col("gross") - F.col("cost"))
    return out


def portfolio(books: DataFrame, run: Sequence[str]) -> DataFrame:
    """One row per (run, date) before costs."""
    return books.groupBy(*run, "date").agg(
        F.sum(F.col("weight") * F.col("forward_return")).alias("gross_return"),
        F.sum("weight_turnover").alias("turnover"),
        F.max("n_active").alias("n_active"),
    )


def with_costs(dates: DataFrame, levels: Sequence[float] = COST_LEVELS) -> DataFrame:
    """Every round-trip cost level of the date-level table."""
    rates = F.array(
        *[
            F.struct(
                F.lit(float(b)).alias("bps"),
                F.lit(CostModel.from_round_trip_bps(b).rate).alias("rate"),
            )
            for b in levels
        ]
    )
    out = dates.withColumn("_c", F.explode(rates))
    return (
        out.withColumn("cost_bps", F.col("_c.bps"))
        .withColumn("cost", F.col("turnover") * F.col("_c.rate"))
        .withColumn("net_return", F.col("gross_return") - F.col("cost"))
        .drop("_c")
    )


def equity_curve(dates: DataFrame, run: Sequence[str]) -> DataFrame:
    """Compounded equity per run (product, not exp-sum-log: a factor may be negative)."""
    s = Series(keys=run)
    return dates.withColumn("equity", F.product(1 + F.col("net_return")).over(s.running))


def compute_stats(curve: DataFrame, run: Sequence[str], periods: int = PERIODS_PER_YEAR) -> DataFrame:
    """Performance statistics of each run; NULL where the data cannot support one."""
    run = list(run)
    s = Series(keys=run)
    before = s.spec.rowsBetween(Window.unboundedPreceding, -1)
    peak = F.greatest(F.lit(1.0), F.coalesce(F.max("equity").over(before), F.lit(1.0)))
    rows = curve.withColumn("_peak", F.greatest(peak, F.col("equity")))
    rows = rows.withColumn("_at_peak", F.col("equity") >= peak)
    # Longest peak-to-recovery span: a span closes on the first peak row after a dip and
    # is measured from the last peak row before it (the first date if there is none).
    last_peak = F.coalesce(
        F.last(F.when(F.col("_at_peak"), F.col("date")), ignorenulls=True).over(before),
        F.first("date").over(s.running),
    )
    rows = rows.withColumn("_since", F.date_diff("date", last_peak)).withColumn(
        "_was_under", ~F.coalesce(F.lag("_at_peak").over(s.spec), F.lit(True))
    )
    r = F.col("net_return")
    held = F.col("n_active") > 0
    win, loss = F.when(held & (r > 0), r), F.when(held & (r < 0), r)
    down = F.least(r, F.lit(0.0))
    g = rows.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_periods"),
        (F.max_by("equity", "date") - 1).alias("total_return"),
        F.stddev_samp(r).alias("_sd"),
        F.avg(r).alias("_mean"),
        F.sqrt(F.avg(down * down)).alias("_down"),
        F.min(F.col("equity") / F.col("_peak") - 1).alias("max_drawdown"),
        F.coalesce(
            F.max(F.when(F.col("_at_peak") & F.col("_was_under"), F.col("_since"))), F.lit(0)
        ).alias("_closed"),
        F.max_by(F.when(~F.col("_at_peak"), F.col("_since")), "date").alias("_open"),
        F.sum(held.cast("bigint")).alias("_held"),
        F.count(win).alias("_wins"),
        F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"),
        F.avg("turnover").alias("_turn"),
    )
    n = F.col("n_periods").cast("double")
    total = F.col("total_return")
    root = math.sqrt(periods)
    g = g.withColumn(
        "annual_return", finite(F.when(1 + total > 0, F.pow(1 + total, periods / n) - 1))
    )
    ratio = lambda a, b: F.when(b > 0, a / b)
    return g.select(
        *run,
        total,
        "annual_return",
        (F.col("_sd") * root).alias("annual_vol"),
        (ratio(F.col("_mean"), F.col("_sd")) * root).alias("sharpe"),
        F.when(n > 1, ratio(F.col("_mean"), F.col("_down")) * root).alias("sortino"),
        "max_drawdown",
        F.greatest("_closed", F.coalesce("_open", F.lit(0))).cast("bigint").alias("max_drawdown_days"),
        F.coalesce(F.col("_open") >= F.col("_closed"), F.lit(False)).alias("max_drawdown_unrecovered"),
        F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")).alias("calmar"),
        (F.col("_held") / n).alias("exposure"),
        F.when(F.col("_held") > 0, F.col("_wins") / F.col("_held")).alias("hit_rate"),
        "avg_win",
        "avg_loss",
        F.abs(F.try_divide(F.col("avg_win"), F.col("avg_loss"))).alias("win_loss_ratio"),
        (F.col("_turn") * periods).alias("annual_turnover"),
        "n_periods",
    )


def curves(positions: DataFrame, run: Sequence[str], levels: Sequence[float] = COST_LEVELS) -> DataFrame:
    """Equity curve of every run at every cost level."""
    dates = with_costs(portfolio(book(positions, run), run), levels)
    return equity_curve(dates, [*run, "cost_bps"])


def buy_and_hold(positions: DataFrame, run: Sequence[str]) -> DataFrame:
    """The same keys held long at no cost, reported with a NULL cost level."""
    held = positions.withColumn("position", F.lit(1.0))
    dates = with_costs(portfolio(book(held, run), run), [0.0])
    return equity_curve(dates, run).withColumn("cost_bps", F.lit(None).cast("double"))


def cost_sweep(
    positions: DataFrame, run: Sequence[str], levels: Sequence[float] = COST_LEVELS,
    periods: int = PERIODS_PER_YEAR,
) -> DataFrame:
    """Statistics at every cost level plus a buy-and-hold row per run."""
    run = list(run)
    key = [*run, "cost_bps"]
    label = lambda df, name: df.withColumn("strategy", F.lit(name))
    active = label(compute_stats(curves(positions, run, levels), key, periods), "model")
    passive = label(compute_stats(buy_and_hold(positions, run), key, periods), "buy_and_hold")
    return active.unionByName(passive)


def per_asset_sweep(positions: DataFrame, levels: Sequence[float] = COST_LEVELS) -> DataFrame:
    """Each asset as a standalone book."""
    return cost_sweep(positions, ["model", "asset"], levels)
