"""Leakage audits: truncation invariance and suspiciously correlated features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import moments
from barloom.operators.scaling import unpivot


def causality_audit(
    build: Callable[[DataFrame], DataFrame], panel: DataFrame, cut: str, columns: Sequence[str]
) -> DataFrame:
    """Rebuild features without the rows after ``cut`` and compare what is left.

    A causal feature cannot change: per column, the largest difference and the number of
    rows where only one build has a value.
    """
    until = F.col("date") <= F.lit(cut).cast("date")
    found = compare_builds(build(panel).filter(until), build(panel.filter(until)), columns)
    return found.drop("n_rows")


def compare_builds(full: DataFrame, short: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, max_diff, n_mismatch, n_rows) over the keys of both builds.

    A key of only one build counts as a mismatch where its feature has a value.
    """
    a = unpivot(full, ["asset", "date"], columns).withColumnRenamed("value", "a")
    b = unpivot(short, ["asset", "date"], columns).withColumnRenamed("value", "b")
    joined = a.join(b, ["asset", "date", "feature"], "full_outer")
    one_sided = F.col("a").isNull() != F.col("b").isNull()
    return joined.groupBy("feature").agg(
        F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("max_diff"),
        F.sum(one_sided.cast("bigint")).alias("n_mismatch"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def leak_screen(
    matrix: DataFrame, columns: Sequence[str], against: Sequence[str], threshold: float = 0.999
) -> DataFrame:
    """Absolute correlation of each feature with each target and the same-day close.

    An undefined correlation is flagged too: it cannot clear a feature.
    """
    long = matrix.select(
        *against, F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
        ])).alias("_f"),
    ).select(*against, "_f.*")
    g = long.groupBy("feature").agg(*[F.abs(moments.corr("value", t)).alias(t) for t in against])
    out = unpivot_values(g, against)
    return out.withColumn("flagged", F.coalesce(F.col("abs_corr") > threshold, F.lit(True)))


def unpivot_values(g: DataFrame, against: Sequence[str]) -> DataFrame:
    return g.unpivot(["feature"], list(against), "target", "abs_corr")
