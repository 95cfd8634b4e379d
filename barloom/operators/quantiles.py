"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer.  Here a
bounded sketch proposes cut points around each wanted rank, one pass counts the values
between the cut points, and only the cells that hold a wanted rank are ranked value by
value.  The counts are exact, so a poor sketch costs time and never changes a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """One row per (keys, prob) with the linearly interpolated quantile ``q``.

    Cells hold about ``10 / ACCURACY`` of a group and repeated values in them collapse
    into counted rows.  Per group the cut points are ``2 * len(probs)`` numbers; groups
    are meant to be folds times features, so the small tables are broadcast.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs).drop("_all")
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    slack = 5.0 / ACCURACY
    edges = sorted({e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))})
    cuts = data.groupBy(*keys).agg(F.percentile_approx("_v", edges, ACCURACY).alias("_cuts"))
    # Cell i holds the values above i cut points: intervals closed on the right.
    cells = data.join(F.broadcast(cuts), keys).select(
        *keys, F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_cell"), "_v"
    )
    counts = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    # At most one row per cut point and group from here to the located cells.
    up = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(
        *keys, "_cell", "_c", F.sum("_c").over(up).alias("_upto"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"),
    )
    ranks = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    wanted = F.array(*[f(r).cast("bigint") for r in ranks for f in (F.floor, F.ceil)])
    before = F.col("_upto") - F.col("_c")
    located = placed.select(*keys, "_cell", "_n", before.alias("_before"), "_upto").filter(
        F.exists(wanted, lambda r: (F.col("_before") <= r) & (r < F.col("_upto")))
    ).drop("_upto")
    values = (
        cells.join(F.broadcast(located), [*keys, "_cell"])
        .groupBy(*keys, "_cell", "_n", "_before", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    within = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.col("_before") + F.sum("_c").over(within))
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    at = lambda rank: F.max(F.when((first <= rank) & (rank <= last), F.col("_v")))
    picks, found = [], []
    for i, (p, rank) in enumerate(zip(probs, ranks)):
        picks += [
            at(F.floor(rank)).alias(f"_a{i}"),
            at(F.ceil(rank)).alias(f"_b{i}"),
            F.max(rank - F.floor(rank)).alias(f"_f{i}"),
        ]
        a, b, f = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_f{i}")
        found.append(F.struct(F.lit(float(p)).alias("prob"), (a + (b - a) * f).alias("q")))
    picked = ranked.groupBy(*keys).agg(*picks)
    return picked.select(*keys, F.explode(F.array(*found)).alias("_q")).select(*keys, "_q.*")
