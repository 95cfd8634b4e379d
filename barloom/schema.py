"""Column names and Spark types of the relations the library passes around.

The central relation is the *panel*: one row per ``(asset, date)``.  ``date`` is a
DATE, so one asset can hold at most one row per calendar day (about 73,000 rows for
two centuries).  That is the bound that makes a window partitioned by ``asset``, or a
table with one row per date, safe whatever the number of assets.  Panels keyed by a
timestamp have no such bound; :mod:`barloom.operators.blocks` serves those.
"""

from pyspark.sql import types as T

ASSET = "asset"
DATE = "date"
KEY = (ASSET, DATE)

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("asset", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("quote_volume", T.DoubleType()),
        T.StructField("trades", T.LongType()),
        T.StructField("taker_buy_quote_volume", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
PANEL_COLUMNS = PANEL_SCHEMA.fieldNames()

# The twelve positional columns of a landed kline file.
KLINE_COLUMNS = [
    "open_time",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time",
    "quote_volume",
    "trades",
    "taker_buy_volume",
    "taker_buy_quote_volume",
    "ignore",
]

TARGETS = ("ret_1d", "dir_1d", "vol_1d", "realised_var_1d", "fwd_ret_simple")
META = ("close", "high", "low", "ret_lag1", "realised_var_now")

# Feature prefix -> family name (fixed values).
FAMILIES = {
    "px_": "price",
    "vol_": "volume",
    "rng_": "range_vol",
    "tech_": "technical",
    "xa_": "cross_asset",
    "cal_": "calendar",
    "aux_": "auxiliary",
}

PREDICTION_COLUMNS = [
    "asset",
    "date",
    "pred",
    "proba",
    "model",
    "fold",
    "seed",
    "target",
    "y_true",
]
