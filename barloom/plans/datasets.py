"""The library's relations derived from the star-schema tables of a data folder.

A line item plays a trade: its return flag is the instrument, its ship date the bar and
a tempered unit price the trade price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.folds import FoldPlan
from barloom.plans.session import cut_lineage
from barloom.sources.trades import bars

REFERENCE = "A"
TRADE_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
)
ONCHAIN = ("adractcnt", "txcnt", "splycur")
MACRO = ("vixcls", "dgs10")
WARMUP = 90

EXPANDING = FoldPlan(
    train_start="1995-01-01", first_test_start="1997-01-01", test_months=3, step_months=3,
    embargo_days=5, horizon=1, inner_val_frac=0.2, min_train_rows=500,
)
ROLLING = FoldPlan(
    train_start="1995-01-01", first_test_start="1997-01-01", test_months=3, step_months=3,
    embargo_days=5, horizon=1, inner_val_frac=0.2, min_train_rows=500,
    scheme="rolling", rolling_train_years=3,
)
YEARLY = FoldPlan(
    train_start="1995-01-01", first_test_start="1997-01-01", test_months=12, step_months=12,
    embargo_days=5, horizon=1, inner_val_frac=0.2, min_train_rows=500,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_order():
    """The whole tuple that orders trades. (order, line) repeats, and ties must not depend on the task order."""
    return F.struct(*TRADE_ORDER)


def trade_price():
    return F.pow(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(0.05))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per return flag."""
    filled = F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))
    return bars(
        table(spark, sf_dir, "lineitem"),
        asset="l_returnflag",
        bucket=F.to_date("l_shipdate"),
        price=trade_price(),
        order_by=F.col(TRADE_ORDER[0]),
        ties=F.struct(*TRADE_ORDER[1:]),
        volume="l_quantity",
        quote_volume="l_extendedprice",
        taker_buy=filled,
        source="lineitem",
    )


def frozen_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel materialised once, for plans that read it several times."""
    return cut_lineage(panel(spark, sf_dir))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type: an intraday panel keyed by a timestamp."""
    return bars(
        table(spark, sf_dir, "events"),
        asset="event_type",
        bucket=F.date_trunc("hour", F.col("ts").cast("timestamp")),
        price=F.col("value"),
        order_by=F.col("ts"),
        volume="value",
        quote_volume="value",
        taker_buy=F.when(F.col("user_id") % 2 == 0, F.col("value")),
        source="events",
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = (F.col("o_orderstatus") == "F").cast("double")
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.avg(done) * 100).alias("fng")
    )


def onchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts in two steps, so that no trade is copied per counted column.

    The first step keeps one row per bar and supplier (or order), which spreads a large bar over many tasks.
    """
    li = table(spark, sf_dir, "lineitem")
    bar = [F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date")]

    def distinct(column, name, *more):
        once = li.groupBy(*bar, column).agg(F.count(F.lit(1)).alias("_n"), *more)
        sums = [F.sum(c).alias(c) for c in once.columns if c not in ("asset", "date", column, "_n")]
        return once.groupBy("asset", "date").agg(F.count(column).cast("double").alias(name), *sums)

    suppliers = distinct("l_suppkey", "adractcnt")
    orders = distinct("l_orderkey", "txcnt", F.sum("l_quantity").alias("splycur"))
    return suppliers.join(orders, ["asset", "date"]).select("asset", "date", *ONCHAIN)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .filter(F.weekday(day) < 5)
        .groupBy(day.alias("date"))
        .agg(
            (F.avg("o_totalprice") / 1000).alias("vixcls"),
            F.count(F.lit(1)).cast("double").alias("dgs10"),
        )
    )


def second_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "O")
    return li.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("asset")).agg(
        F.max_by(trade_price(), trade_order()).alias("close")
    )
