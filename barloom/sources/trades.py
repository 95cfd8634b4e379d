"""Bars from a trade-level table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import col


def bars(
    trades: DataFrame,
    *,
    asset: Column | str,
    bucket: Column,
    price: Column,
    order_by: Column,
    volume: Column | str,
    quote_volume: Column | str,
    taker_buy: Column,
    source: str,
    bucket_name: str = "date",
    ties: Column | None = None,
) -> DataFrame:
    """One row per (asset, bucket): first/last/extreme price and summed activity.

    A single partially aggregated pass: one scan, no join, one exchange, and a bucket
    holding most of the trades still reaches the shuffle as one row per map task.
    ``order_by`` must order the trades of a bucket totally.  A number or a timestamp keeps
    the aggregate hash based.  Where it does not suffice, ``ties`` orders trades of equal
    ``order_by``; a key of several columns makes each map task sort its own split by bar
    before it aggregates, which costs no exchange and spills where memory is short.
    """
    # Evaluated once per trade, not once per aggregate.
    rows = trades.select(
        bucket.alias(bucket_name), col(asset).alias("asset"), price.alias("_p"), order_by.alias("_o"),
        col(volume).alias("_v"), col(quote_volume).alias("_q"), taker_buy.alias("_t"),
        *([] if ties is None else [ties.alias("_ties")]),
    )
    key = F.col("_o") if ties is None else F.struct("_o", "_ties")
    out = (
        rows.groupBy(bucket_name, "asset")
        .agg(
            F.min_by("_p", key).alias("open"),
            F.max_by("_p", key).alias("close"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.sum("_v").alias("volume"),
            F.sum("_q").alias("quote_volume"),
            F.count(F.lit(1)).alias("trades"),
            F.coalesce(F.sum("_t"), F.lit(0.0)).alias("taker_buy_quote_volume"),
        )
    )
    return out.select(
        "asset", bucket_name, "open", "high", "low", "close", "volume", "quote_volume",
        "trades", "taker_buy_quote_volume", F.lit(source).alias("source"),
    )
