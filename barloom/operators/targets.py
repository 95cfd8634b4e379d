"""Forward-looking target columns — the only ones that read a later row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import positive_ln, safe_ratio
from barloom.functions.series import Series

FOUR_LN_2 = 4.0 * math.log(2.0)


def parkinson(high="high", low="low") -> Column:
    """Parkinson range variance of one bar."""
    r = positive_ln(safe_ratio(high, low))
    return r * r / FOUR_LN_2


def add_targets(panel: DataFrame, horizon: int = 1, keys=("asset",)) -> DataFrame:
    """Next-row log return, its direction, next-bar variance and simple return."""
    s = Series(keys)
    ret = s.lead(F.ln("close"), horizon) - F.ln("close")
    var = F.when(parkinson() > 0, parkinson())
    return (
        panel.withColumn("ret_1d", ret)
        .withColumn("realised_var_1d", s.lead(var, horizon))
        .withColumn("fwd_ret_simple", safe_ratio(s.lead("close", horizon), F.col("close")) - 1)
        .withColumn("dir_1d", F.when(F.col("ret_1d").isNotNull(), (F.col("ret_1d") > 0).cast("double")))
        .withColumn("vol_1d", F.ln("realised_var_1d"))
    )


def add_meta(panel: DataFrame, keys=("asset",)) -> DataFrame:
    """Raw columns baselines may read: last return and this bar's variance."""
    return panel.withColumn("ret_lag1", Series(keys).diff(F.ln("close"))).withColumn(
        "realised_var_now", parkinson()
    )
