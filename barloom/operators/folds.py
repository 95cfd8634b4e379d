"""Purged and embargoed walk-forward folds.

Fold boundaries and counts only need the number of panel rows per date, a table bounded
by the calendar, so the panel itself is read once for those counts and once for the
membership join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import is_date_keyed


@dataclass(frozen=True)
class FoldPlan:
    train_start: str
    first_test_start: str
    test_months: int = 3
    step_months: int = 3
    scheme: str = "expanding"
    rolling_train_years: int = 3
    embargo_days: int = 5
    horizon: int = 1
    inner_val_frac: float = 0.2
    min_train_rows: int = 500

    def __post_init__(self):
        if self.scheme not in ("expanding", "rolling"):
            raise ValueError(f"unknown scheme {self.scheme!r}")
        if not 0.0 < self.inner_val_frac < 0.5:
            raise ValueError("inner_val_frac must lie between 0 and 0.5")
        if int(self.first_test_start[-2:]) > 28:
            raise ValueError("test windows must start on day 28 or earlier")

    @property
    def gap_days(self) -> int:
        return self.horizon + self.embargo_days


def _n(condition) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")


def candidate_windows(per_date: DataFrame, plan: FoldPlan) -> DataFrame:
    """Boundary dates of every test window starting before the last panel date."""
    first = F.lit(plan.first_test_start).cast("date")
    start = F.lit(plan.train_start).cast("date")
    step = F.expr(f"interval {plan.step_months} month")
    starts = per_date.agg(F.max("date").alias("last")).select(
        "last", F.explode(F.sequence(first, F.greatest(first, F.col("last")), step)).alias("ts")
    )
    window_start = start
    if plan.scheme == "rolling":
        window_start = F.greatest(start, F.add_months("ts", -12 * plan.rolling_train_years))
    return starts.filter("ts < last").select(
        "ts",
        F.add_months("ts", plan.test_months).alias("te"),
        F.date_sub("ts", plan.horizon).alias("purge"),
        F.date_sub("ts", plan.gap_days).alias("embargo"),
        window_start.alias("ws"),
    )


def walk_forward_folds(panel: DataFrame, plan: FoldPlan) -> DataFrame:
    """One row per emitted fold: boundaries, actual dates and row counts."""
    per_date = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    windows = F.broadcast(candidate_windows(per_date, plan))
    reach = per_date.join(
        windows, (F.col("date") >= F.col("ws")) & (F.col("date") < F.col("te"))
    )
    d = F.col("date")
    train, test = d < F.col("embargo"), d >= F.col("ts")
    bounds = ["ts", "te", "purge", "embargo", "ws"]
    # The validation cut is a position in the sorted distinct training dates.
    trained = reach.withColumn("_train", train)
    w = Window.partitionBy("ts", "_train").orderBy("date")
    total = F.count(F.lit(1)).over(Window.partitionBy("ts", "_train"))
    at = F.floor(total * F.lit(1.0 - plan.inner_val_frac))
    trained = trained.withColumn(
        "_cut", F.when(F.col("_train") & (F.row_number().over(w) - 1 == at), F.col("date"))
    )
    cut = F.max("_cut").over(Window.partitionBy("ts"))
    marked = trained.withColumn("val_cut", cut).withColumn(
        "inner", F.date_sub("val_cut", plan.gap_days)
    )
    inner, val = d < F.col("inner"), train & (d >= F.col("val_cut"))
    day = lambda fn, cond: fn(F.when(cond, d))
    folds = marked.groupBy(*bounds, "val_cut", "inner").agg(
        _n(train).alias("n_full_train"),
        _n(inner).alias("n_train"),
        _n(val).alias("n_val"),
        _n(test).alias("n_test"),
        _n((d >= F.col("purge")) & ~test).alias("n_purged"),
        _n((d >= F.col("embargo")) & (d < F.col("purge"))).alias("n_embargoed"),
        day(F.min, inner).alias("train_start"),
        day(F.max, inner).alias("train_end"),
        day(F.min, val).alias("val_start"),
        day(F.max, val).alias("val_end"),
        day(F.min, test).alias("test_start"),
        day(F.max, test).alias("test_end"),
    )
    kept = folds.filter(
        (F.col("n_full_train") >= plan.min_train_rows) & (F.col("n_test") > 0)
    )
    order = Window.partitionBy(F.lit(0)).orderBy("ts")
    return kept.withColumn("fold", (F.row_number().over(order) - 1).cast("int"))


DESCRIBE = (
    "fold", "train_start", "train_end", "n_train", "val_start", "val_end", "n_val",
    "test_start", "test_end", "n_test", "n_purged", "n_embargoed",
)


def describe(folds: DataFrame) -> DataFrame:
    return folds.select(*DESCRIBE)


def assign_splits(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Fold membership: the panel row once per fold and split it belongs to.

    The fold table has one row per test window of the calendar, so the range join
    broadcasts it whatever the size of the panel.
    """
    b = folds.select("fold", "ws", "inner", "val_cut", "embargo", "ts", "te")
    b = F.broadcast(b) if is_date_keyed(panel) else b
    d = F.col("date")
    in_reach = (d >= F.col("ws")) & (d < F.col("te"))
    split = (
        F.when(d >= F.col("ts"), "test")
        .when((d >= F.col("val_cut")) & (d < F.col("embargo")), "val")
        .when(d < F.col("inner"), "train")
    )
    joined = panel.join(b, in_reach).withColumn("split", split).filter("split is not null")
    return joined.drop("ws", "inner", "val_cut", "embargo", "ts", "te")


def integrity_audit(membership: DataFrame, plan: FoldPlan) -> DataFrame:
    """Per fold: gaps between the splits, overlaps, and whether all rules hold."""
    edge = lambda fn, s: fn(F.when(F.col("split") == s, F.col("date")))
    spans = membership.groupBy("fold").agg(
        edge(F.max, "train").alias("train_end"),
        edge(F.min, "val").alias("val_start"),
        edge(F.max, "val").alias("val_end"),
        edge(F.min, "test").alias("test_start"),
    )
    shared = (
        membership.groupBy("fold", "asset", "date").count().filter("count > 1")
        .groupBy("fold").agg(F.count(F.lit(1)).alias("n_overlap"))
    )
    out = spans.join(shared, "fold", "left").select(
        "fold",
        F.coalesce("n_overlap", F.lit(0)).cast("bigint").alias("n_overlap"),
        F.date_diff("val_start", "train_end").cast("bigint").alias("inner_gap"),
        F.date_diff("test_start", "val_end").cast("bigint").alias("outer_gap"),
    )
    need = plan.gap_days
    return out.withColumn(
        "ok",
        (F.col("n_overlap") == 0) & (F.col("inner_gap") > need) & (F.col("outer_gap") > need),
    )
