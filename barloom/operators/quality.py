"""Panel validation.  Each check is a DataFrame; ``validate_panel`` turns them into one
findings table ``(check, severity, n_bad, message)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.series import Series

PRICES = ("open", "high", "low", "close")
ERROR, WARNING, INFO = "error", "warning", "info"


class PanelInvalid(ValueError):
    """The panel failed at least one error-level check."""


def duplicate_keys(df: DataFrame, keys=("asset", "date")) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).count().filter("count > 1")


def check_panel_key(df: DataFrame, keys=("asset", "date")) -> None:
    """Raise when key columns are missing or not unique."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise PanelInvalid(f"panel lacks key columns {missing}")
    offenders = duplicate_keys(df, keys).limit(5).collect()
    if offenders:
        raise PanelInvalid(f"duplicate keys, first offenders: {offenders}")


def off_midnight(bars: DataFrame, ts: str = "open_ts") -> DataFrame:
    """Bars per asset that do not open at 00:00 UTC."""
    t = F.col(ts)
    off = (F.hour(t) != 0) | (F.minute(t) != 0) | (F.second(t) != 0)
    return bars.groupBy("asset").agg(F.sum(off.cast("bigint")).alias("n_bad"))


def timestamp_order(df: DataFrame, order: str | None = None) -> DataFrame:
    """Per asset: repeated dates, and steps backwards along an ingestion-order column."""
    dup = df.groupBy("asset", "date").agg(F.count(F.lit(1)).alias("n"))
    dup = dup.groupBy("asset").agg(F.sum(F.col("n") - 1).alias("n_duplicates"))
    if order is None:
        return dup
    s = Series(order=[order])
    back = df.select("asset", (F.col("date") < s.lag("date")).alias("b"))
    back = back.groupBy("asset").agg(
        F.coalesce(F.sum(F.col("b").cast("bigint")), F.lit(0).cast("bigint")).alias("n_backward")
    )
    return dup.join(back, "asset")


def calendar_gaps(panel: DataFrame) -> DataFrame:
    """Runs of missing days between an asset's first and last bar.

    Reading the gap off the next bar's date needs no generated calendar, so the work
    grows with the bars present rather than with the days absent.
    """
    nxt = Series().lead("date")
    return (
        panel.select(
            "asset",
            F.date_add("date", 1).alias("gap_start"),
            F.date_sub(nxt, 1).alias("gap_end"),
            (F.date_diff(nxt, F.col("date")) - 1).cast("bigint").alias("missing_days"),
        )
        .filter("missing_days > 0")
    )


def missing_days(panel: DataFrame) -> DataFrame:
    """Every absent (asset, date) inside an asset's own span."""
    days = F.explode(F.sequence("gap_start", "gap_end"))
    return calendar_gaps(panel).select("asset", days.alias("date"))


def nonpositive_price() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) <= 0 for c in PRICES])


def misordered_bar() -> Column:
    body = (F.col("open"), F.col("close"))
    return reduce(
        lambda a, b: a | b,
        [F.col("low") > c for c in body] + [F.col("high") < c for c in body],
    )


def price_checks(panel: DataFrame) -> DataFrame:
    """Counts of every row-level check, per asset, in one pass."""
    n = lambda cond: F.coalesce(
        F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0).cast("bigint")
    )
    return panel.groupBy("asset").agg(
        n(nonpositive_price()).alias("ohlc_positive"),
        n(misordered_bar()).alias("ohlc_ordering"),
        n(F.col("volume") < 0).alias("negative_volume"),
        n(F.col("volume") == 0).alias("zero_volume"),
    )


def offending_rows(panel: DataFrame, condition: Column, k: int = 20) -> DataFrame:
    """The first ``k`` rows failing a check, for a report."""
    return panel.filter(condition).orderBy("asset", "date").limit(k)


def return_outliers(panel: DataFrame, threshold: float = 0.5, k: int | None = 25) -> DataFrame:
    """Largest one-row log returns above ``threshold`` in absolute value.

    A close that is not positive has no logarithm: its return and the next one are NULL.
    """
    log_return = Series().diff(F.when(F.col("close") > 0, F.ln("close")))
    out = (
        panel.select("asset", "date", log_return.alias("log_return"))
        .filter(F.abs("log_return") > threshold)
    )
    return out.orderBy(F.desc(F.abs("log_return")), "asset", "date").limit(k) if k else out


def coverage(panel: DataFrame) -> DataFrame:
    """Rows, span and missing calendar days per asset."""
    days = F.date_diff(F.max("date"), F.min("date"))
    return panel.groupBy("asset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.round(days / 365.25, 2).alias("years"),
        (days + 1).cast("bigint").alias("calendar_days"),
        (days + 1 - F.count(F.lit(1))).cast("bigint").alias("missing_days"),
    )


def source_agreement(
    a: DataFrame, b: DataFrame, *, by=("asset",), on=("asset", "date"),
    max_abs_pct_diff: float = 1.0, min_agreement_frac: float = 0.99,
) -> tuple[DataFrame, DataFrame]:
    """Compare ``close`` of two venues on their common dates.

    Returns the overall table per ``by`` and the per-year table.  A series has one row
    per date, so the medians see a bounded group.
    """
    joined = a.join(b.withColumnRenamed("close", "close_b"), list(on), "inner").select(
        *on, (F.try_divide(F.col("close") - F.col("close_b"), F.col("close_b")) * 100).alias("pct"),
    )
    agree = (F.abs("pct") <= max_abs_pct_diff).cast("double")
    overall = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg(agree).alias("agree_frac"),
        F.percentile("pct", 0.5).alias("median_basis"),
        F.max(F.abs("pct")).alias("worst_abs"),
    )
    overall = overall.withColumn(
        "severity", F.when(F.col("agree_frac") < min_agreement_frac, WARNING).otherwise(INFO)
    )
    yearly = joined.groupBy(*by, F.year("date").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("days"),
        F.round(F.avg(agree), 4).alias("agree_frac"),
        F.round(F.percentile("pct", 0.5), 4).alias("median_basis"),
        F.round(F.max(F.abs("pct")), 4).alias("worst_abs"),
    )
    return overall, yearly


def agreement_finding(overall: DataFrame) -> DataFrame:
    """One finding for the whole comparison; no common day at all is a warning."""
    worst = overall.agg(
        F.coalesce(F.sum("days"), F.lit(0)).alias("days"),
        F.sum((F.col("severity") == WARNING).cast("bigint")).alias("n_bad"),
    )
    none = F.col("days") == 0
    return worst.select(
        F.lit("cross_source_agreement").alias("check"),
        F.when(none | (F.col("n_bad") > 0), WARNING).otherwise(INFO).alias("severity"),
        F.coalesce("n_bad", F.lit(0)).cast("bigint").alias("n_bad"),
        F.when(none, "no overlapping dates").otherwise("venues compared").alias("message"),
    )


def auxiliary_summary(aux: DataFrame) -> DataFrame:
    """Rows and span of each tagged source."""
    return aux.groupBy("_source").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last")
    )


def validate_panel(panel: DataFrame, outlier_threshold: float = 0.5) -> DataFrame:
    """All panel findings: one row per check with its severity and offender count."""
    counts = price_checks(panel).agg(
        *[
            F.sum(c).alias(c)
            for c in ("ohlc_positive", "ohlc_ordering", "negative_volume", "zero_volume")
        ]
    )
    levels = {
        "ohlc_positive": ERROR, "ohlc_ordering": ERROR,
        "negative_volume": ERROR, "zero_volume": WARNING,
    }
    stacked = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("check"), F.lit(level).alias("severity"),
                        F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias("n_bad"),
                    )
                    for name, level in levels.items()
                ]
            )
        ).alias("f")
    ).select("f.*")
    single = lambda name, level, df, n: df.agg(
        F.lit(name).alias("check"), F.lit(level).alias("severity"),
        F.coalesce(n, F.lit(0)).cast("bigint").alias("n_bad"),
    )
    parts = [
        stacked,
        single("monotonic_timestamps", ERROR, timestamp_order(panel), F.sum("n_duplicates")),
        single("calendar_gaps", WARNING, calendar_gaps(panel), F.sum("missing_days")),
        single("return_outliers", WARNING,
               return_outliers(panel, outlier_threshold, None), F.count(F.lit(1))),
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.select(
        "check",
        F.when(F.col("n_bad") > 0, F.col("severity")).otherwise(INFO).alias("severity"),
        "n_bad",
        F.when(F.col("n_bad") > 0, F.concat(F.col("n_bad").cast("string"), F.lit(" offending")))
        .otherwise("ok").alias("message"),
    )


def order_findings(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == ERROR, 0).when(F.col("severity") == WARNING, 1).otherwise(2)
    return findings.orderBy(rank, "check")


def raise_if_failed(findings: DataFrame) -> None:
    """Raise when any finding is an error (a findings table has one row per check)."""
    bad = findings.filter(F.col("severity") == ERROR).collect()
    if bad:
        raise PanelInvalid("; ".join(f"{r['check']}: {r['message']}" for r in bad))


