"""Per-asset feature families.  Each adds its columns to the panel and keeps its key.

All windows are row-positional over ``keys`` ordered by date and look only backwards.
The deepest lookback is 91 rows (plus the smoothing memory for ``tech_``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import (
    SD_FLOOR,
    floor_at,
    positive_ln,
    safe_ratio,
    sd_ratio,
)
from barloom.functions.rolling import add_rolling
from barloom.functions.series import Series
from barloom.operators import blocks
from barloom.operators.ewm import add_ewm, add_ewm_blocks, from_span
from barloom.operators.targets import parkinson

# Window lengths in rows.
RET_LAGS = (1, 2, 3, 5, 10, 21)
MEAN_WINDOWS = (5, 10, 21, 63)
MOMENT_WINDOWS = (21, 63)
CUMULATIVE_WINDOWS = (7, 30, 90)
EXTREME_WINDOWS = (21, 63)
RANGE_WINDOWS = (5, 21)
SMOOTHED = {
    "_avg_gain": ("_gain", 1 / 14),
    "_avg_loss": ("_loss", 1 / 14),
    "_fast": ("close", from_span(12)),
    "_slow": ("close", from_span(26)),
}
SIGNAL = {"_signal": ("_macd", from_span(9))}
TECH_HALO = 21


def _scratch(df: DataFrame, keys) -> DataFrame:
    """Log close and one-row return, shared by the families."""
    return df.withColumn("_lc", F.ln("close")).withColumn("_r1", Series(keys).diff("_lc"))


def _tidy(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Drop scratch columns the family introduced."""
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in panel.columns])


def add_price(panel: DataFrame, keys=("asset",)) -> DataFrame:
    """``px_``: returns, their rolling moments, cumulative sums, distance to extremes."""
    s = Series(keys)
    df = _scratch(panel, keys)
    rolls = {}
    for n in MEAN_WINDOWS:
        rolls[f"px_ret_mean_{n}"] = ("mean", "_r1", n)
        rolls[f"px_ret_std_{n}"] = ("std", "_r1", n)
    for n in MOMENT_WINDOWS:
        rolls[f"px_ret_skew_{n}"] = ("skew", "_r1", n)
        rolls[f"px_ret_kurt_{n}"] = ("kurt", "_r1", n)
    for n in CUMULATIVE_WINDOWS:
        rolls[f"px_cumret_{n}"] = ("sum", "_r1", n)
    for n in EXTREME_WINDOWS:
        rolls[f"_max_{n}"] = ("max", "_lc", n)
        rolls[f"_min_{n}"] = ("min", "_lc", n)
    df = add_rolling(df, s, rolls)
    c = {f"px_ret_{k}": s.diff("_lc", k) for k in RET_LAGS}
    for n in EXTREME_WINDOWS:
        c[f"px_dist_max_{n}"] = F.col("_lc") - F.col(f"_max_{n}")
        c[f"px_dist_min_{n}"] = F.col("_lc") - F.col(f"_min_{n}")
    return _tidy(df.withColumns(c), panel)


def add_volume(panel: DataFrame, keys=("asset",)) -> DataFrame:
    """``vol_``: log activity, z-scores, taker share and return/volume correlation."""
    s = Series(keys)
    df = _scratch(panel, keys).withColumns(
        {
            "vol_log1p_volume": F.log1p("volume"),
            "vol_log1p_quote_volume": F.log1p("quote_volume"),
            "_lt": F.log1p(F.col("trades").cast("double")),
            "vol_taker_buy_ratio": safe_ratio("taker_buy_quote_volume", "quote_volume"),
        }
    )
    df = add_rolling(
        df,
        s,
        {
            "vol_zscore_21": ("zscore", "vol_log1p_quote_volume", 21),
            "vol_trades_zscore_21": ("zscore", "_lt", 21),
            "vol_taker_buy_ratio_mean_7": ("mean", "vol_taker_buy_ratio", 7),
            "vol_ret_corr_21": ("corr", ("_r1", "vol_log1p_quote_volume"), 21),
        },
    )
    c = {
        "vol_qv_median_ratio_63": safe_ratio("quote_volume", s.median("quote_volume", 63)),
        "vol_taker_buy_ratio_dev": F.col("vol_taker_buy_ratio") - 0.5,
    }
    return _tidy(df.withColumns(c), panel)


def add_range_vol(panel: DataFrame, keys=("asset",)) -> DataFrame:
    """``rng_``: Parkinson and Garman-Klass volatility, true range, bar position."""
    s = Series(keys)
    hl = positive_ln(safe_ratio("high", "low"))
    oc = positive_ln(safe_ratio("close", "open"))
    prev = F.col("_prev")
    true_range = F.when(
        prev.isNotNull(),
        F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        ),
    )
    df = _scratch(panel, keys).withColumn("_prev", s.lag("close"))
    df = df.withColumns(
        {
            "_pk": parkinson(),
            "_gk": hl * hl * 0.5 - oc * oc * (2 * math.log(2.0) - 1),
            "_tr": true_range,
            "rng_intraday": hl,
            "rng_close_position": safe_ratio(
                F.col("close") - F.col("low"), F.col("high") - F.col("low")
            ),
        }
    )
    rolls = {"_atr": ("mean", "_tr", 14), "_sd": ("std", "_r1", 21)}
    for n in RANGE_WINDOWS:
        rolls[f"_pk_{n}"] = ("mean", "_pk", n)
        rolls[f"_gk_{n}"] = ("mean", "_gk", n)
    df = add_rolling(df, s, rolls)
    c = {
        "rng_tr_norm": safe_ratio("_tr", "close"),
        "rng_atr_14_norm": safe_ratio("_atr", "close"),
    }
    for n in RANGE_WINDOWS:
        c[f"rng_parkinson_{n}"] = F.sqrt(floor_at(f"_pk_{n}", 0.0))
        c[f"rng_garman_klass_{n}"] = F.sqrt(floor_at(f"_gk_{n}", 0.0))
    df = df.withColumns(c)
    ratio = sd_ratio(F.col("_sd"), F.col("rng_parkinson_21"))
    return _tidy(df.withColumn("rng_cc_parkinson_ratio_21", ratio), panel)


def add_technical(panel: DataFrame, keys=("asset",)) -> DataFrame:
    """``tech_``: RSI, MACD, Bollinger position, stochastics and OBV z-score."""
    s = Series(keys)
    df = add_ewm(_moves(panel, s), SMOOTHED, s).withColumn("_macd", F.col("_fast") - F.col("_slow"))
    return _tidy(_technical(add_ewm(df, SIGNAL, s), s), panel)


def add_technical_blocks(
    panel: DataFrame, *, bucket: Column, keys=("asset",), block_rows: int = blocks.DEFAULT_BLOCK
) -> DataFrame:
    """``add_technical`` for series too long for one task; ``bucket`` as in ``blocks.number_rows``.

    Smoothed values are carried over blocks as affine maps.  The OBV enters only as a z-score,
    which a running sum begun in the block's halo leaves unchanged.
    """
    numbered = blocks.number_rows(panel, keys, ("date",), bucket)
    cut = {"keys": keys, "block_rows": block_rows}
    df = blocks.on_blocks(numbered, lambda d, k: _moves(d, Series(k)), halo=1, **cut)
    df = add_ewm_blocks(df, SMOOTHED, **cut).withColumn("_macd", F.col("_fast") - F.col("_slow"))
    df = add_ewm_blocks(df, SIGNAL, **cut)
    return _tidy(blocks.on_blocks(df, lambda d, k: _technical(d, Series(k)), halo=TECH_HALO, **cut), panel)


def _moves(panel: DataFrame, s: Series) -> DataFrame:
    delta = F.col("_delta")
    return panel.withColumn("_delta", s.diff("close")).withColumns(
        {
            "_gain": floor_at(delta, 0.0),
            "_loss": floor_at(-delta, 0.0),
            "_signed": F.signum(delta) * F.col("volume"),
        }
    )


def _technical(df: DataFrame, s: Series) -> DataFrame:
    """Indicators of rows with their moves and smoothed values."""
    delta = F.col("_delta")
    df = df.withColumn("_obv", F.when(delta.isNotNull(), s.cumsum("_signed")))
    df = add_rolling(
        df,
        s,
        {
            "_mid": ("mean", "close", 20),
            "_sd": ("std", "close", 20),
            "_low": ("min", "low", 14),
            "_high": ("max", "high", 14),
            # The first bar has no move; the running sum starts with the second.
            "tech_obv_zscore_21": ("zscore", "_obv", 21),
        },
    )
    mid, sd = F.col("_mid"), F.col("_sd")
    df = df.withColumns(
        {
            "tech_rsi_14": safe_ratio("_avg_gain", F.col("_avg_gain") + F.col("_avg_loss")) * 100,
            "tech_macd_line_norm": safe_ratio("_macd", "close"),
            "tech_macd_signal_norm": safe_ratio("_signal", "close"),
            "tech_bb_pos_20": F.when(
                sd > SD_FLOOR, safe_ratio(F.col("close") - (mid - sd * 2), sd * 4)
            ),
            "tech_stoch_k_14": safe_ratio(
                F.col("close") - F.col("_low"), F.col("_high") - F.col("_low")
            ) * 100,
        }
    )
    k = F.col("tech_stoch_k_14")
    df = df.withColumns(
        {
            "tech_macd_hist_norm": F.col("tech_macd_line_norm") - F.col("tech_macd_signal_norm"),
            "tech_stoch_d_14": (k + s.lag(k, 1) + s.lag(k, 2)) / 3,
        }
    )
    return df


def add_calendar(panel: DataFrame, keys=("asset",)) -> DataFrame:
    """``cal_``: cyclic encodings of weekday (Monday first), day and month."""
    phase = {
        "dow": F.weekday("date") / 7.0,
        "dom": (F.dayofmonth("date") - 1) / 31.0,
        "moy": (F.month("date") - 1) / 12.0,
    }
    c = {}
    for name, p in phase.items():
        c[f"cal_{name}_sin"] = F.sin(p * (2 * math.pi))
        c[f"cal_{name}_cos"] = F.cos(p * (2 * math.pi))
    c["cal_is_weekend"] = (F.weekday("date") >= 5).cast("double")
    return panel.withColumns(c)
