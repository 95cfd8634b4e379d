"""Second-venue candles and auxiliary daily series in their landed shapes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.expr import finite
from barloom.sources.klines import keep_last

# Field order of one candle array, newest candle first in a page.
CANDLE_FIELDS = ("epoch", "low", "high", "open", "close", "volume")


def read_candles_json(pages: DataFrame, body: str = "body", order: Sequence[str] = ()) -> DataFrame:
    """Positional candle arrays, one JSON document per row, as daily bars.

    Duplicate days keep the last candle in (``order``, position in the page) order.
    """
    rows = F.from_json(F.col(body), "array<array<double>>")
    flat = pages.select(*order, F.posexplode(rows).alias("_pos", "_c"))
    fields = [F.get(F.col("_c"), i).alias(n) for i, n in enumerate(CANDLE_FIELDS)]
    typed = flat.select(*order, "_pos", *fields).withColumn(
        "date", F.to_date(F.timestamp_seconds(F.col("epoch").cast("bigint")))
    )
    typed = typed.filter(F.col("date").isNotNull() & F.col("close").isNotNull())
    kept = keep_last(typed, ["date"], [*order, "_pos"])
    return kept.select("date", "open", "high", "low", "close", "volume")


def read_sentiment(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """(timestamp, value) strings with epoch seconds -> one ``fng`` per day."""
    typed = raw.select(
        F.to_date(F.timestamp_seconds(F.col("timestamp").try_cast("bigint"))).alias("date"),
        finite(F.col("value").try_cast("double")).alias("fng"),
        *order,
    ).filter(F.col("date").isNotNull() & F.col("fng").isNotNull())
    return keep_last(typed, ["date"], order).select("date", "fng")


def read_onchain(raw: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """ISO-8601 ``time``, any-case ``asset`` and string metrics; absent ones are NULL."""
    value = lambda m: (
        finite(F.col(m).try_cast("double")) if m in raw.columns else F.lit(None).cast("double")
    )
    return raw.select(
        F.to_date(F.try_to_timestamp(F.col("time"))).alias("date"),
        F.upper("asset").alias("asset"),
        *[value(m).alias(m) for m in metrics],
    ).filter(F.col("date").isNotNull() & F.col("asset").isNotNull())


def coalesce_partials(frames: Sequence[DataFrame], metrics: Sequence[str]) -> DataFrame:
    """Many partial frames -> the first non-null value of each metric per (date, asset)."""
    tagged = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    present = lambda m: F.when(F.col(m).isNotNull(), F.col("_frame"))
    return stacked.groupBy("date", "asset").agg(
        *[F.min_by(m, present(m)).alias(m) for m in metrics]
    )


def read_macro_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One series CSV: first column is the date by position; '.' and '' are missing."""
    raw = spark.read.option("header", "true").csv(path)
    day, value = raw.columns[0], raw.columns[1]
    line = F.monotonically_increasing_id().alias("position")
    return macro_series(raw.select(F.col(day).alias("date"), F.col(value).alias("value"), line), name)


def macro_series(raw: DataFrame, name: str) -> DataFrame:
    """Tidy (date, value) rows; ``position``, where there is one, orders repeats of a date."""
    position = F.col("position").cast("long") if "position" in raw.columns else F.lit(0).cast("long")
    return raw.select(
        F.col("date").try_cast("date").alias("date"),
        F.lit(name).alias("series"),
        finite(F.col("value").try_cast("double")).alias("value"),
        position.alias("position"),
    ).filter(F.col("date").isNotNull())


def macro_wide(series: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Outer merge of the series: one row per date seen in any of them.

    Stacking and pivoting gives the rows of a chained full outer join in one shuffle.
    A date repeated within a series keeps the value at its last position (the largest value
    where rows carry no position).
    """
    stacked = reduce(DataFrame.unionByName, series)
    return stacked.groupBy("date").agg(
        *[
            F.max_by("value", F.when(F.col("series") == n, F.struct("position", F.coalesce("value", F.lit(float("-inf")))))).alias(n)
            for n in names
        ]
    )
