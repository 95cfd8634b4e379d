"""Queries over the panel sources, targets, per-asset and cross-asset features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import rounded
from barloom.operators import audit, auxiliary, blocks, cross_asset, features, matrix
from barloom.operators.ewm import add_ewm, add_ewm_blocks
from barloom.operators.targets import add_meta, add_targets
from barloom.plans import datasets as ds
from barloom.plans import sqltext as q
from barloom.plans.registry import query
from barloom.plans.session import cut_lineage
from barloom.schema import TARGETS


def keyed(df, columns, digits=6):
    return rounded(df.select("asset", "date", *columns), digits)


# -- sources --------------------------------------------------------------------


@query(
    "daily_bars",
    f"""WITH {q.BARS} SELECT asset, date, round(open, 6) AS open, round(high, 6) AS high,
    round(low, 6) AS low, round(close, 6) AS close, round(volume, 4) AS volume,
    round(quote_volume, 2) AS quote_volume, trades,
    round(taker_buy_quote_volume, 2) AS taker_buy_quote_volume, source FROM bars""",
)
def daily_bars(spark, sf):
    p = ds.panel(spark, sf)
    r = lambda c, n: F.round(c, n).alias(c)
    return p.select(
        "asset", "date", r("open", 6), r("high", 6), r("low", 6), r("close", 6), r("volume", 4),
        r("quote_volume", 2), "trades", r("taker_buy_quote_volume", 2), "source",
    )


# -- targets and meta -----------------------------------------------------------


@query(
    "targets",
    q.keyed(q.TARGETS, {c: c for c in TARGETS}, "m"),
)
def targets(spark, sf):
    return keyed(add_targets(ds.panel(spark, sf)), TARGETS)


@query(
    "panel_meta",
    q.keyed(q.TARGETS, {c: c for c in ("close", "high", "low", "ret_lag1", "realised_var_now")}, "m"),
)
def panel_meta(spark, sf):
    return keyed(add_meta(ds.panel(spark, sf)), ["close", "high", "low", "ret_lag1", "realised_var_now"])


@query(
    "warmup_filter",
    f"WITH {q.TARGETS} SELECT asset, date, round(dir_1d, 6) AS dir_1d FROM m "
    f"WHERE i >= {ds.WARMUP} AND dir_1d IS NOT NULL",
)
def warmup_filter(spark, sf):
    m = add_targets(ds.panel(spark, sf))
    return matrix.drop_warmup(m, ds.WARMUP, "dir_1d").select("asset", "date", F.round("dir_1d", 6).alias("dir_1d"))


# -- price ----------------------------------------------------------------------


def _lag(k):
    return f"lag(lc, {k}) OVER ({q.W})"


PX = {f"px_ret_{k}": f"lc - {_lag(k)}" for k in features.RET_LAGS}
for n in features.MEAN_WINDOWS:
    PX[f"px_ret_mean_{n}"] = q.roll("avg", "r1", n)
    PX[f"px_ret_std_{n}"] = q.roll("stddev_samp", "r1", n)
for n in features.CUMULATIVE_WINDOWS:
    PX[f"px_cumret_{n}"] = q.roll("sum", "r1", n)
for n in features.EXTREME_WINDOWS:
    PX[f"px_dist_max_{n}"] = f"lc - {q.roll('max', 'lc', n)}"
    PX[f"px_dist_min_{n}"] = f"lc - {q.roll('min', 'lc', n)}"
PX_MOMENTS = {}
for n in features.MOMENT_WINDOWS:
    guard = q.roll("stddev_samp", "r1", n)
    PX_MOMENTS[f"px_ret_skew_{n}"] = f"CASE WHEN {guard} > 1e-12 THEN {q.roll('skewness', 'r1', n)} END"
    PX_MOMENTS[f"px_ret_kurt_{n}"] = f"CASE WHEN {guard} > 1e-12 THEN {q.roll('kurtosis', 'r1', n)} END"


@query("price_features", q.keyed(q.RET, PX, "r"))
def price_features(spark, sf):
    return keyed(features.add_price(ds.panel(spark, sf)), PX)


@query("price_moments", q.keyed(q.RET, PX_MOMENTS, "r", 4))
def price_moments(spark, sf):
    return keyed(features.add_price(ds.panel(spark, sf)), PX_MOMENTS, 4)


# -- volume ---------------------------------------------------------------------

TBR = "(CASE WHEN quote_volume <> 0 THEN taker_buy_quote_volume / quote_volume END)"
LQV = "ln(1 + quote_volume)"
VOL = {
    "vol_log1p_volume": "ln(1 + volume)",
    "vol_log1p_quote_volume": LQV,
    "vol_zscore_21": q.zscore(LQV, 21),
    "vol_qv_median_ratio_63": f"quote_volume / {q.roll('median', 'quote_volume', 63)}",
    "vol_trades_zscore_21": q.zscore("ln(1 + trades)", 21),
    "vol_taker_buy_ratio": TBR,
    "vol_taker_buy_ratio_mean_7": q.roll("avg", TBR, 7),
    "vol_taker_buy_ratio_dev": f"{TBR} - 0.5",
    "vol_ret_corr_21": q.corr("r1", LQV, 21),
}


@query("volume_features", q.keyed(q.RET, VOL, "r"))
def volume_features(spark, sf):
    return keyed(features.add_volume(ds.panel(spark, sf)), VOL)


# -- range volatility -----------------------------------------------------------

HL = "ln(high / low)"
GK = f"(0.5 * pow({HL}, 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2))"
RNG_CTE = q.RET + f""",
g AS (SELECT *, {q.PK} AS pk, {GK} AS gk,
  CASE WHEN lag(close) OVER ({q.W}) IS NOT NULL THEN greatest(high - low,
    abs(high - lag(close) OVER ({q.W})), abs(low - lag(close) OVER ({q.W}))) END AS tr FROM r)"""


def _root(x, n):
    return f"sqrt(CASE WHEN {q.roll('avg', x, n)} IS NOT NULL THEN greatest({q.roll('avg', x, n)}, 0) END)"


RNG = {
    "rng_parkinson_5": _root("pk", 5),
    "rng_parkinson_21": _root("pk", 21),
    "rng_garman_klass_5": _root("gk", 5),
    "rng_garman_klass_21": _root("gk", 21),
    "rng_tr_norm": "tr / close",
    "rng_atr_14_norm": f"{q.roll('avg', 'tr', 14)} / close",
    "rng_cc_parkinson_ratio_21": (
        f"CASE WHEN {_root('pk', 21)} > 1e-12 THEN {q.roll('stddev_samp', 'r1', 21)} / {_root('pk', 21)} END"
    ),
    "rng_intraday": HL,
    "rng_close_position": "CASE WHEN high <> low THEN (close - low) / (high - low) END",
}


@query("range_vol_features", q.keyed(RNG_CTE, RNG, "g"))
def range_vol_features(spark, sf):
    return keyed(features.add_range_vol(ds.panel(spark, sf)), RNG)


# -- technical ------------------------------------------------------------------


def ewm_sql(x: str, alpha: str) -> str:
    """Literal recursion over the ordered non-null history of each row."""
    hist = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({q.W} ROWS UNBOUNDED PRECEDING)"
    return f"list_reduce({hist}, lambda a, v: (1 - {alpha}) * a + {alpha} * v)"


TECH_STEPS = f"""
d AS (SELECT *, close - lag(close) OVER ({q.W}) AS delta FROM r),
u AS (SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain,
   CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS loss, sign(delta) * volume AS sv FROM d),
e AS (SELECT *, {ewm_sql("gain", "1.0/14")} AS ag, {ewm_sql("loss", "1.0/14")} AS al,
   {ewm_sql("close", "2.0/13")} - {ewm_sql("close", "2.0/27")} AS macd,
   sum(sv) OVER ({q.W} ROWS UNBOUNDED PRECEDING) AS obv,
   CASE WHEN {q.roll("max", "high", 14)} - {q.roll("min", "low", 14)} <> 0 THEN
     100 * (close - {q.roll("min", "low", 14)}) / ({q.roll("max", "high", 14)} - {q.roll("min", "low", 14)}) END AS k
   FROM u),
x AS (SELECT *, {ewm_sql("macd", "0.2")} AS sig FROM e)"""
TECH_CTE = q.RET + "," + TECH_STEPS
_SD20 = q.roll("stddev_samp", "close", 20)
TECH = {
    "tech_rsi_14": "CASE WHEN ag + al <> 0 THEN 100 * ag / (ag + al) END",
    "tech_macd_line_norm": "macd / close",
    "tech_macd_signal_norm": "sig / close",
    "tech_macd_hist_norm": "macd / close - sig / close",
    "tech_bb_pos_20": (
        f"CASE WHEN {_SD20} > 1e-12 THEN (close - ({q.roll('avg', 'close', 20)} - 2 * {_SD20})) / (4 * {_SD20}) END"
    ),
    "tech_stoch_k_14": "k",
    "tech_stoch_d_14": q.roll("avg", "k", 3),
    "tech_obv_zscore_21": q.zscore("obv", 21),
}


@query("technical_features", q.keyed(TECH_CTE, TECH, "x"))
def technical_features(spark, sf):
    return keyed(features.add_technical(ds.panel(spark, sf)), TECH)


@query(
    "ewm_close",
    q.keyed(q.RET, {"ewm_12": ewm_sql("close", "2.0/13"), "ewm_06": ewm_sql("close", "0.06")}, "r"),
)
def ewm_close(spark, sf):
    out = add_ewm(ds.panel(spark, sf), {"ewm_12": ("close", 2 / 13), "ewm_06": ("close", 0.06)})
    return keyed(out, ["ewm_12", "ewm_06"])


# -- calendar -------------------------------------------------------------------


def _cyc(name, phase):
    return {
        f"cal_{name}_sin": f"sin(2 * pi() * {phase})",
        f"cal_{name}_cos": f"cos(2 * pi() * {phase})",
    }


CAL = {
    **_cyc("dow", "((isodow(date) - 1) / 7.0)"),
    **_cyc("dom", "((day(date) - 1) / 31.0)"),
    **_cyc("moy", "((month(date) - 1) / 12.0)"),
    "cal_is_weekend": "CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END",
}


@query("calendar_features", q.keyed(q.BARS, CAL, "bars"))
def calendar_features(spark, sf):
    return keyed(features.add_calendar(ds.panel(spark, sf)), CAL)


# -- cross asset ----------------------------------------------------------------

DENSE = q.RET + """,
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS di FROM (SELECT DISTINCT date FROM bars)),
names AS (SELECT DISTINCT asset FROM bars),
grid AS (SELECT names.asset, days.date, days.di, r.r1 FROM days CROSS JOIN names
   LEFT JOIN r ON r.asset = names.asset AND r.date = days.date)"""

REF_CTE = DENSE + f""",
ref AS (SELECT date, r1 AS f, lag(r1) OVER (ORDER BY date) AS f1, lag(r1, 2) OVER (ORDER BY date) AS f2
   FROM grid WHERE asset = '{ds.REFERENCE}'),
refs AS (SELECT date, f, f1, f2, {q.roll("avg", "f1", 5, part="")} AS m5,
   {q.roll("stddev_samp", "f1", 21, part="")} AS v21, {q.roll("sum", "f", 7, part="")} AS s7,
   {q.roll("sum", "f", 30, part="")} AS s30 FROM ref),
gc AS (SELECT grid.asset, grid.date, {q.corr("r1", "f", 30)} AS c30, {q.corr("r1", "f", 90)} AS c90
   FROM grid JOIN ref USING (date)),
own AS (SELECT asset, date, {q.roll("sum", "r1", 7)} AS o7, {q.roll("sum", "r1", 30)} AS o30 FROM r),
x AS (SELECT own.asset, own.date, f1, f2, m5, v21, c30, c90, o7 - s7 AS rs7, o30 - s30 AS rs30
   FROM own JOIN refs USING (date) JOIN gc ON gc.asset = own.asset AND gc.date = own.date)"""
REF = {
    "xa_ref_ret_lag1": "f1", "xa_ref_ret_lag2": "f2", "xa_ref_ret_mean_5": "m5",
    "xa_ref_vol_21": "v21", "xa_corr_ref_30": "c30", "xa_corr_ref_90": "c90",
    "xa_rel_strength_7": "rs7", "xa_rel_strength_30": "rs30",
}


@query("cross_asset_reference", q.keyed(REF_CTE, REF, "x"))
def cross_asset_reference(spark, sf):
    return keyed(cross_asset.add_reference(ds.frozen_panel(spark, sf), ds.REFERENCE), REF)


XS_CTE = DENSE + f""",
lagged AS (SELECT asset, date, lag(r1) OVER ({q.W}) AS l FROM grid),
mk AS (SELECT date, avg(l) AS m, stddev_samp(l) AS sd FROM lagged GROUP BY date),
mm AS (SELECT date, m, sd, {q.roll("avg", "m", 5, part="")} AS m5 FROM mk),
rk AS (SELECT a.asset, a.date, a.l, CASE WHEN a.l IS NOT NULL THEN
    (count(*) FILTER (WHERE b.l < a.l) + (count(*) FILTER (WHERE b.l = a.l) + 1) / 2.0)
     / count(b.l) END AS rank
  FROM lagged a JOIN lagged b ON a.date = b.date GROUP BY a.asset, a.date, a.l),
x AS (SELECT r.asset, r.date, rk.rank, mm.m, mm.m5, mm.sd, rk.l - mm.m AS ex
  FROM r JOIN mm USING (date) JOIN rk ON rk.asset = r.asset AND rk.date = r.date)"""
XS = {
    "xa_rank_ret_lag1": "rank", "xa_market_ret_lag1": "m", "xa_market_ret_mean_5": "m5",
    "xa_market_dispersion": "sd", "xa_excess_ret_lag1": "ex",
}


@query("cross_section", q.keyed(XS_CTE, XS, "x"))
def cross_section(spark, sf):
    return keyed(cross_asset.add_cross_section(ds.frozen_panel(spark, sf)), XS)


# -- auxiliary ------------------------------------------------------------------

_DAYS = ",\ndays AS (SELECT DISTINCT date FROM bars)"
SENT = """,
sent AS (SELECT CAST(o_orderdate AS DATE) AS date,
   100 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS fng FROM orders GROUP BY 1)"""
SENT_CTE = q.BARS + _DAYS + SENT + f""",
s AS (SELECT days.date, lag(fng) OVER (ORDER BY days.date) AS x FROM days LEFT JOIN sent USING (date)),
f AS (SELECT date, x, x - lag(x, 7) OVER (ORDER BY date) AS c7, {q.zscore("x", 63, part="")} AS z FROM s),
x AS (SELECT asset, date, x, c7, z FROM bars JOIN f USING (date))"""


@query(
    "aux_sentiment",
    q.keyed(SENT_CTE, {"aux_fng": "x", "aux_fng_chg_7": "c7", "aux_fng_z_63": "z"}, "x"),
)
def aux_sentiment(spark, sf):
    out = auxiliary.add_sentiment(ds.frozen_panel(spark, sf), ds.sentiment(spark, sf))
    return keyed(out, ["aux_fng", "aux_fng_chg_7", "aux_fng_z_63"])


CHAIN = """,
chain AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date,
   count(DISTINCT l_suppkey) AS adractcnt, count(DISTINCT l_orderkey) AS txcnt,
   sum(l_quantity) AS splycur FROM lineitem GROUP BY 1, 2)"""
_LOGS = ", ".join(
    f"ln(1 + CASE WHEN lag({m}) OVER ({q.W}) IS NOT NULL THEN greatest(lag({m}) OVER ({q.W}), 0) END) AS {m}"
    for m in ds.ONCHAIN
)
CHAIN_CTE = q.BARS + CHAIN + f""",
j AS (SELECT bars.asset, bars.date, adractcnt, txcnt, splycur FROM bars LEFT JOIN chain
   ON chain.asset = bars.asset AND chain.date = bars.date),
l AS (SELECT asset, date, {_LOGS} FROM j)"""
CHAIN_COLS = {}
for _m in ds.ONCHAIN:
    CHAIN_COLS[f"aux_{_m}_z63"] = q.zscore(_m, 63, 21)
    CHAIN_COLS[f"aux_{_m}_chg_7"] = f"{_m} - lag({_m}, 7) OVER ({q.W})"


@query("aux_onchain", q.keyed(CHAIN_CTE, CHAIN_COLS, "l"))
def aux_onchain(spark, sf):
    out = auxiliary.add_onchain(ds.panel(spark, sf), ds.onchain(spark, sf), ds.ONCHAIN)
    return keyed(out, CHAIN_COLS)


MACRO_CTE = q.BARS + _DAYS + """,
mac AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1000 AS vixcls,
   CAST(count(*) AS DOUBLE) AS dgs10 FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1),
ff AS (SELECT days.date,
   last_value(vixcls IGNORE NULLS) OVER (ORDER BY days.date ROWS UNBOUNDED PRECEDING) AS v,
   last_value(dgs10 IGNORE NULLS) OVER (ORDER BY days.date ROWS UNBOUNDED PRECEDING) AS g
   FROM days LEFT JOIN mac USING (date)),
lg AS (SELECT date, lag(v) OVER (ORDER BY date) AS v, lag(g) OVER (ORDER BY date) AS g FROM ff),
f AS (SELECT date, v, v - lag(v, 5) OVER (ORDER BY date) AS v5, g - lag(g, 1) OVER (ORDER BY date) AS g1,
   g - lag(g, 21) OVER (ORDER BY date) AS g21 FROM lg),
x AS (SELECT asset, date, v, v5, g1, g21 FROM bars JOIN f USING (date))"""
MACRO_COLS = {"aux_vixcls": "v", "aux_vixcls_chg_5": "v5", "aux_dgs10_chg_1": "g1", "aux_dgs10_chg_21": "g21"}


@query("aux_macro", q.keyed(MACRO_CTE, MACRO_COLS, "x", 10))
def aux_macro(spark, sf):
    out = auxiliary.add_macro(ds.frozen_panel(spark, sf), ds.macro(spark, sf), ds.MACRO)
    return keyed(out, MACRO_COLS, 10)


# -- matrix ---------------------------------------------------------------------

ALL_FAMILIES = (*matrix.BUILDERS, "cross_asset", "auxiliary")


def all_features(spark, sf, panel, cut=None):
    """Every family; with ``cut``, from a panel and auxiliary series that end there."""
    until = (lambda df: df) if cut is None else (lambda df: df.filter(F.col("date") <= F.lit(cut).cast("date")))
    return matrix.build_features(
        until(panel), ALL_FAMILIES, reference=ds.REFERENCE,
        sentiment=until(ds.sentiment(spark, sf)), onchain=until(ds.onchain(spark, sf)),
        onchain_metrics=ds.ONCHAIN, macro=until(ds.macro(spark, sf)), macro_series=ds.MACRO,
    )


def full_matrix(spark, sf):
    return add_targets(add_meta(all_features(spark, sf, ds.frozen_panel(spark, sf))))


@query("feature_matrix")
def feature_matrix(spark, sf):
    """Every family at once, after warmup."""
    return rounded(matrix.drop_warmup(full_matrix(spark, sf), ds.WARMUP, "dir_1d"))


@query("family_summary")
def family_summary(spark, sf):
    return matrix.family_summary(full_matrix(spark, sf))


CUTS = ("2000-03-31",)


@query(
    "causality_audit_full",
    f"WITH {q.BARS}, c AS (SELECT unnest({list(CUTS)}) AS cut) "
    "SELECT cut, count(*) AS n_rows, 0::BIGINT AS n_changed FROM c JOIN bars ON date <= CAST(cut AS DATE) GROUP BY 1",
)
def causality_audit_full(spark, sf):
    """Every feature of every family, rebuilt without the panel rows and auxiliary values after each cut."""
    panel = ds.frozen_panel(spark, sf)
    every = lambda cut: all_features(spark, sf, panel, cut)
    whole = cut_lineage(every(None))
    names = matrix.feature_columns(whole)
    parts = []
    for cut in CUTS:
        until = F.col("date") <= F.lit(cut).cast("date")
        found = audit.compare_builds(whole.filter(until), every(cut), names)
        changed = F.count_if((F.round("max_diff", 9) > 0) | (F.col("n_mismatch") > 0))
        parts.append(found.agg(F.lit(cut).alias("cut"), F.max("n_rows").alias("n_rows"), changed.alias("n_changed")))
    return reduce(DataFrame.unionByName, parts)


@query("leak_screen_full")
def leak_screen_full(spark, sf):
    """Every feature of every family against the targets and the close of the day."""
    m = cut_lineage(full_matrix(spark, sf))
    against = ("ret_1d", "dir_1d", "vol_1d", "close")
    return rounded(audit.leak_screen(m, matrix.feature_columns(m), against))


# -- intraday bars through halo blocks --------------------------------------------

INTRADAY = {
    "px_ret_1": "r1", "px_ret_mean_21": q.roll("avg", "r1", 21),
    "px_ret_std_21": q.roll("stddev_samp", "r1", 21), "px_cumret_90": q.roll("sum", "r1", 90),
}


@query(
    "intraday_blocks",
    q.keyed(
        q.EVENT_BARS + f""", p AS (SELECT * FROM ebars WHERE close > 0),
        r AS (SELECT *, ln(close) - lag(ln(close)) OVER ({q.W}) AS r1 FROM p)""",
        INTRADAY, "r",
    ),
)
def intraday_blocks(spark, sf):
    """Price features of an intraday panel, computed block by block."""
    p = ds.event_bars(spark, sf).filter("close > 0")
    out = blocks.blockwise(
        p, features.add_price, halo=91, bucket=F.to_date("date"), block_rows=128
    )
    return keyed(out.withColumn("date", F.col("date").cast("timestamp_ntz")), INTRADAY)


EVENT_ROWS = q.EVENT_BARS + ", r AS (SELECT * FROM ebars)"


@query(
    "intraday_ewm",
    q.keyed(EVENT_ROWS, {"ewm_12": ewm_sql("close", "2.0/13"), "ewm_06": ewm_sql("close", "0.06")}, "r"),
)
def intraday_ewm(spark, sf):
    """Exponential means of an intraday panel, carried from block to block."""
    numbered = blocks.number_rows(ds.event_bars(spark, sf), ("asset",), ("date",), F.to_date("date"))
    out = add_ewm_blocks(numbered, {"ewm_12": ("close", 2 / 13), "ewm_06": ("close", 0.06)}, block_rows=128)
    return keyed(out.withColumn("date", F.col("date").cast("timestamp_ntz")), ["ewm_12", "ewm_06"])


@query("intraday_technical", q.keyed(EVENT_ROWS + "," + TECH_STEPS, TECH, "x"))
def intraday_technical(spark, sf):
    """RSI, MACD, bands, stochastics and OBV of an intraday panel, block by block."""
    out = features.add_technical_blocks(ds.event_bars(spark, sf), bucket=F.to_date("date"), block_rows=128)
    return keyed(out.withColumn("date", F.col("date").cast("timestamp_ntz")), TECH)


@query(
    "matched_metrics",
    f"""WITH {q.BARS}, x AS (
      SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date, count(DISTINCT l_suppkey) AS adractcnt,
        count(DISTINCT l_orderkey) AS txcnt, sum(l_quantity) AS splycur FROM lineitem GROUP BY 1, 2),
    m AS (SELECT adractcnt, txcnt, splycur FROM bars JOIN x USING (asset, date))
    SELECT 'adractcnt' AS metric FROM m HAVING count(adractcnt) > 0
    UNION ALL SELECT 'txcnt' FROM m HAVING count(txcnt) > 0
    UNION ALL SELECT 'splycur' FROM m HAVING count(splycur) > 0""",
)
def matched_metrics(spark, sf):
    """On-chain metrics with a value on some panel row; a metric that never has one is left out."""
    unseen = ds.onchain(spark, sf).withColumn("never", F.lit(None).cast("double"))
    names = auxiliary.matched_metrics(ds.panel(spark, sf), unseen, (*ds.ONCHAIN, "never"))
    return spark.createDataFrame([(n,) for n in names], "metric string")
