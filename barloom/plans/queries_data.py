"""Queries over landed shapes, validation, exploration and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import rounded
from barloom.operators import audit, explore, features, quality
from barloom.operators.targets import add_meta, add_targets
from barloom.plans import datasets as ds
from barloom.plans import sqltext as q
from barloom.plans.registry import query
from barloom.sources import auxiliary, klines

ORDER = ds.TRADE_ORDER
_O = ", ".join(ORDER)
SHIFT_DAYS = 7305
SYMBOLS = {"AUSD": "A", "NUSD": "N", "RUSD": "R"}


# -- landed shapes ------------------------------------------------------------------


def raw_klines(spark, sf, shift=SHIFT_DAYS):
    """Line items as untyped kline rows: mixed epoch units, bad numbers, repeats."""
    li = ds.table(spark, sf, "lineitem")
    # Twenty years on: epochs before September 2001 are not plausible milliseconds.
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + shift * 86400
    epoch = F.when(F.col("l_linenumber") % 2 == 0, seconds * 1000).otherwise(seconds * 1000000)
    text = lambda c: F.col(c).cast("string")
    return li.select(
        F.concat("l_returnflag", F.lit("USD")).alias("symbol"),
        epoch.cast("string").alias("open_time"),
        F.when(F.col("l_quantity") == 13, "bad").otherwise(text("l_extendedprice")).alias("open"),
        text("l_extendedprice").alias("high"), text("l_discount").alias("low"),
        F.when(F.col("l_quantity") == 7, "").otherwise(text("l_extendedprice")).alias("close"),
        text("l_quantity").alias("volume"), text("l_extendedprice").alias("quote_volume"),
        F.when(F.col("l_linenumber") != 3, text("l_linenumber")).alias("trades"),
        text("l_tax").alias("taker_buy_quote_volume"),
        *ORDER,
    )


TIDY = f"""td AS (SELECT l_returnflag || 'USD' AS symbol, CAST(l_shipdate AS DATE) + {SHIFT_DAYS} AS date,
  last(CASE WHEN l_quantity = 13 THEN NULL ELSE l_extendedprice END ORDER BY {_O}) AS open,
  last(l_extendedprice ORDER BY {_O}) AS high, last(l_discount ORDER BY {_O}) AS low,
  last(l_extendedprice ORDER BY {_O}) AS close, last(l_quantity ORDER BY {_O}) AS volume,
  last(l_extendedprice ORDER BY {_O}) AS quote_volume,
  last(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_linenumber END ORDER BY {_O})::BIGINT AS trades,
  last(l_tax ORDER BY {_O}) AS taker_buy_quote_volume
 FROM lineitem WHERE l_quantity <> 7 GROUP BY 1, 2)"""


@query(
    "tidy_klines",
    f"WITH {TIDY} SELECT symbol, date, open, high, low, close, volume, quote_volume, trades, taker_buy_quote_volume FROM td",
)
def tidy_klines(spark, sf):
    return klines.tidy_klines(raw_klines(spark, sf), ORDER).select(
        "symbol", "date", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_quote_volume"
    )


@query(
    "assemble_panel",
    f"""WITH {TIDY} SELECT CASE symbol WHEN 'AUSD' THEN 'A' WHEN 'NUSD' THEN 'N' WHEN 'RUSD' THEN 'R' END AS asset, date, open, high, low, close, volume,
  quote_volume, trades, taker_buy_quote_volume, 'landed' AS source FROM td WHERE symbol IN ('AUSD', 'NUSD', 'RUSD')""",
)
def assemble_panel(spark, sf):
    return klines.assemble_panel(klines.tidy_klines(raw_klines(spark, sf), ORDER), SYMBOLS, "landed")


@query(
    "ingest_findings",
    """WITH raw AS (SELECT l_returnflag || 'USD' AS symbol, l_quantity = 7 AS no_close,
  l_linenumber % 2 = 0 AND epoch_ms(l_shipdate) < 1000000000000 OR l_linenumber % 2 = 1 AND epoch_us(l_shipdate) < 1000000000000 AS early FROM lineitem),
 c AS (SELECT symbol, 'implausible_epoch' AS "check", count(*) FILTER (WHERE early) AS n FROM raw GROUP BY 1
  UNION ALL SELECT symbol, 'unreadable_close', count(*) FILTER (WHERE no_close) FROM raw GROUP BY 1
  UNION ALL SELECT symbol, 'unmapped_symbol', count(*) FROM raw WHERE symbol = 'RUSD' GROUP BY 1)
 SELECT 'error' AS severity, "check", symbol, n FROM c WHERE n > 0""",
)
def ingest_findings(spark, sf):
    """The same rows without the shift, where old dates in milliseconds are not plausible, and one symbol unmapped."""
    known = {k: v for k, v in SYMBOLS.items() if k != "RUSD"}
    return klines.ingest_findings(raw_klines(spark, sf, 0), known)


@query(
    "epoch_units",
    f"SELECT CAST(l_shipdate AS DATE) + {SHIFT_DAYS} AS date, count(*) AS n FROM lineitem GROUP BY 1",
)
def epoch_units(spark, sf):
    day = F.to_date(F.timestamp_micros(klines.epoch_micros("open_time")))
    return raw_klines(spark, sf).groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "month_coverage",
    """WITH mo AS (SELECT DISTINCT l_returnflag AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem),
 w AS (SELECT symbol, CAST(g AS DATE) AS month FROM (SELECT DISTINCT symbol FROM mo) s,
   (SELECT unnest(generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '2002-02-01', INTERVAL 1 MONTH)) AS g) t)
 SELECT w.symbol, count(mo.month) AS months_ok, count(*) - count(mo.month) AS months_unavailable,
  min(w.month) FILTER (WHERE mo.month IS NULL) AS first_unavailable
 FROM w LEFT JOIN mo ON mo.symbol = w.symbol AND mo.month = w.month GROUP BY 1""",
)
def month_coverage(spark, sf):
    landed = ds.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.to_date(F.trunc(F.to_date("l_shipdate"), "month")).alias("month")
    )
    return klines.month_coverage(landed, "1994-11-01", "2002-02-01")


@query(
    "second_venue_candles",
    """SELECT CAST(ts AS DATE) AS date, arg_max(value, event_id) AS open, arg_max(value + 1, event_id) AS high,
 arg_max(value - 1, event_id) AS low, arg_max(value, event_id) AS close, arg_max(user_id, event_id)::DOUBLE AS volume FROM events GROUP BY 1""",
)
def second_venue_candles(spark, sf):
    ev = ds.table(spark, sf, "events")
    v = F.col("value")
    parts = [F.unix_timestamp(F.col("ts").cast("timestamp")), v - 1, v + 1, v, v, F.col("user_id")]
    body = F.concat(F.lit("[["), F.concat_ws(",", *[p.cast("string") for p in parts]), F.lit("]]"))
    return auxiliary.read_candles_json(ev.select("event_id", body.alias("body")), order=["event_id"])


@query(
    "sentiment_source",
    "SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS fng FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def sentiment_source(spark, sf):
    o = ds.table(spark, sf, "orders")
    raw = o.select(
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("value"),
        "o_orderkey",
    )
    return auxiliary.read_sentiment(raw, ["o_orderkey"])


@query(
    "onchain_source",
    """SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS asset, count(*) AS n, count(CASE WHEN l_quantity = 5 THEN NULL ELSE l_quantity END) AS txcnt,
 round(sum(l_extendedprice), 2) AS splycur, CAST(0 AS BIGINT) AS adractcnt FROM lineitem GROUP BY 1, 2""",
)
def onchain_source(spark, sf):
    li = ds.table(spark, sf, "lineitem")
    raw = li.select(
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        F.lower("l_returnflag").alias("asset"),
        F.when(F.col("l_quantity") == 5, "-").otherwise(F.col("l_quantity").cast("string")).alias("txcnt"),
        F.col("l_extendedprice").cast("string").alias("splycur"),
    )
    t = auxiliary.read_onchain(raw, ["adractcnt", "txcnt", "splycur"])
    return t.groupBy("date", "asset").agg(
        F.count(F.lit(1)).alias("n"), F.count("txcnt").alias("txcnt"),
        F.round(F.sum("splycur"), 2).alias("splycur"), F.count("adractcnt").alias("adractcnt"),
    )


@query(
    "coalesce_partials",
    """WITH f AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date,
  max(l_quantity) FILTER (WHERE l_linestatus = 'F' AND l_linenumber = 1) AS t0, max(l_quantity) FILTER (WHERE l_linestatus = 'O') AS t1,
  max(l_tax) FILTER (WHERE l_linestatus = 'O') AS s1, max(l_tax) AS s2 FROM lineitem GROUP BY 1, 2)
 SELECT asset, date, coalesce(t0, t1) AS txcnt, coalesce(s1, s2) AS splycur FROM f""",
)
def coalesce_partials(spark, sf):
    li = ds.table(spark, sf, "lineitem").withColumn("asset", F.col("l_returnflag")).withColumn("date", F.to_date("l_shipdate"))
    pick = lambda cond, **c: li.filter(cond).groupBy("date", "asset").agg(
        *[F.max(v).alias(k) for k, v in c.items()])
    frames = [
        pick("l_linestatus = 'F' and l_linenumber = 1", txcnt="l_quantity"),
        pick("l_linestatus = 'O'", txcnt="l_quantity", splycur="l_tax"),
        pick("true", splycur="l_tax"),
    ]
    return auxiliary.coalesce_partials(frames, ["txcnt", "splycur"])


@query(
    "macro_wide",
    """SELECT date, max(a) AS vixcls, max(b) AS dgs10 FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS a, NULL::DOUBLE AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
  UNION ALL SELECT CAST(o_orderdate AS DATE), NULL, CASE WHEN count(*) % 2 = 1 THEN max(o_totalprice) END FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) t GROUP BY 1""",
)
def macro_wide(spark, sf):
    o = ds.table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    price = F.max("o_totalprice").cast("string")
    raw = lambda status, v: o.filter(F.col("o_orderstatus") == status).groupBy("date").agg(
        v.alias("value")).withColumn("date", F.col("date").cast("string"))
    repeated = o.filter("o_orderstatus = 'F'").select(
        F.col("date").cast("string").alias("date"), F.col("o_totalprice").cast("string").alias("value"),
        F.col("o_orderkey").alias("position"),
    )
    a = auxiliary.macro_series(repeated, "vixcls")
    b = auxiliary.macro_series(raw("O", F.when(F.count(F.lit(1)) % 2 == 1, price).otherwise(".")), "dgs10")
    return auxiliary.macro_wide([a, b], ["vixcls", "dgs10"])


# -- validation -----------------------------------------------------------------------


@query(
    "panel_key_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def panel_key_duplicates(spark, sf):
    return quality.duplicate_keys(ds.table(spark, sf, "lineitem"), ("l_orderkey", "l_linenumber"))


@query(
    "timezone_check",
    f"WITH {q.EVENT_BARS} SELECT asset, count(*) FILTER (WHERE hour(date) <> 0) AS n_bad FROM ebars GROUP BY 1",
)
def timezone_check(spark, sf):
    return quality.off_midnight(ds.event_bars(spark, sf), "date")


@query(
    "timestamp_order",
    f"""WITH {q.BARS}, l AS (SELECT asset, date, date < lag(date) OVER (PARTITION BY asset ORDER BY quote_volume, date) AS b FROM bars)
 SELECT asset, 0::BIGINT AS n_duplicates, count(*) FILTER (WHERE b) AS n_backward FROM l GROUP BY 1""",
)
def timestamp_order(spark, sf):
    """Bars taken in order of turnover stand in for an unsorted landing order."""
    p = ds.panel(spark, sf).withColumn("ingest", F.struct("quote_volume", "date"))
    return quality.timestamp_order(p, "ingest")


@query(
    "calendar_gaps",
    f"""WITH {q.BARS}, n AS (SELECT asset, date, lead(date) OVER ({q.W}) AS nx FROM bars)
 SELECT asset, date + 1 AS gap_start, nx - 1 AS gap_end, CAST(nx - date - 1 AS BIGINT) AS missing_days FROM n WHERE nx - date > 1""",
)
def calendar_gaps(spark, sf):
    return quality.calendar_gaps(ds.panel(spark, sf))


@query(
    "missing_days",
    f"""WITH {q.BARS}, s AS (SELECT asset, min(date) AS a, max(date) AS b FROM bars GROUP BY 1),
 d AS (SELECT asset, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
 SELECT asset, date FROM d ANTI JOIN bars USING (asset, date)""",
)
def missing_days(spark, sf):
    return quality.missing_days(ds.panel(spark, sf))


_CHECKS = """count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS ohlc_positive,
 count(*) FILTER (WHERE low > open OR low > close OR high < open OR high < close) AS ohlc_ordering,
 count(*) FILTER (WHERE volume < 0) AS negative_volume, count(*) FILTER (WHERE volume = 0) AS zero_volume"""


@query("ohlc_checks", f"WITH {q.BARS} SELECT asset, {_CHECKS} FROM bars GROUP BY 1")
def ohlc_checks(spark, sf):
    return quality.price_checks(ds.panel(spark, sf))


@query("ohlc_checks_intraday", f"WITH {q.EVENT_BARS} SELECT asset, {_CHECKS} FROM ebars GROUP BY 1")
def ohlc_checks_intraday(spark, sf):
    return quality.price_checks(ds.event_bars(spark, sf))


@query(
    "return_outliers",
    f"WITH {q.RET} SELECT asset, date, round(r1, 6) AS log_return FROM r WHERE abs(r1) > 0.1 ORDER BY abs(r1) DESC, asset, date LIMIT 25",
)
def return_outliers(spark, sf):
    return rounded(quality.return_outliers(ds.panel(spark, sf), 0.1))


@query(
    "coverage",
    f"""WITH {q.BARS} SELECT asset, count(*) AS rows, min(date) AS first, max(date) AS last,
 round((max(date) - min(date)) / 365.25, 2) AS years, CAST(max(date) - min(date) + 1 AS BIGINT) AS calendar_days,
 CAST(max(date) - min(date) + 1 - count(*) AS BIGINT) AS missing_days FROM bars GROUP BY 1""",
)
def coverage(spark, sf):
    return quality.coverage(ds.panel(spark, sf))


AGREE = q.BARS + f""",
v2 AS (SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date, last(pow(l_extendedprice / l_quantity, 0.05) ORDER BY {q.TRADE_ORDER}) AS close_b
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
j AS (SELECT asset, date, (close - close_b) / close_b * 100 AS pct FROM bars JOIN v2 USING (asset, date))"""


@query(
    "source_agreement",
    f"""WITH {AGREE} SELECT asset, count(*) AS days, round(avg(CASE WHEN abs(pct) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS agree_frac,
 round(quantile_cont(pct, 0.5), 6) + 0.0 AS median_basis, round(max(abs(pct)), 6) AS worst_abs,
 CASE WHEN avg(CASE WHEN abs(pct) <= 1 THEN 1.0 ELSE 0.0 END) < 0.99 THEN 'warning' ELSE 'info' END AS severity FROM j GROUP BY 1""",
)
def source_agreement(spark, sf):
    return rounded(quality.source_agreement(ds.panel(spark, sf).select("asset", "date", "close"), ds.second_venue(spark, sf))[0])


@query(
    "source_agreement_yearly",
    f"""WITH {AGREE} SELECT asset, year(date) AS year, count(*) AS days, round(avg(CASE WHEN abs(pct) <= 1 THEN 1.0 ELSE 0.0 END), 4) AS agree_frac,
 round(quantile_cont(pct, 0.5), 4) + 0.0 AS median_basis, round(max(abs(pct)), 4) AS worst_abs FROM j GROUP BY 1, 2""",
)
def source_agreement_yearly(spark, sf):
    return quality.source_agreement(ds.panel(spark, sf).select("asset", "date", "close"), ds.second_venue(spark, sf))[1]


@query("validation_findings")
def validation_findings(spark, sf):
    return quality.validate_panel(ds.frozen_panel(spark, sf))


@query(
    "auxiliary_summary",
    """SELECT 'sentiment' AS _source, count(DISTINCT CAST(o_orderdate AS DATE)) AS rows, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders
 UNION ALL SELECT 'macro', count(DISTINCT CAST(o_orderdate AS DATE)), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders WHERE isodow(o_orderdate) < 6
 UNION ALL SELECT 'onchain', count(*), min(d), max(d) FROM (SELECT DISTINCT l_returnflag, CAST(l_shipdate AS DATE) AS d FROM lineitem)""",
)
def auxiliary_summary(spark, sf):
    tag = lambda df, n: df.select("date", F.lit(n).alias("_source"))
    both = tag(ds.sentiment(spark, sf), "sentiment").unionByName(tag(ds.macro(spark, sf), "macro"))
    return quality.auxiliary_summary(both.unionByName(tag(ds.onchain(spark, sf), "onchain")))


# -- exploration ------------------------------------------------------------------------


@query(
    "rebased_price",
    q.keyed(q.BARS, {"rebased": f"close / first_value(close) OVER ({q.W})"}, "bars"),
)
def rebased_price(spark, sf):
    return rounded(explore.rebased_price(ds.panel(spark, sf)))


RR = q.RET + ",\nrr AS (SELECT asset, date, r1 AS r FROM r WHERE r1 IS NOT NULL)"


@query(
    "return_histogram",
    "WITH " + RR + """,
sp AS (SELECT asset, min(r) AS lo, max(r) AS hi, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sd, (max(r) - min(r)) / 150 AS w FROM rr GROUP BY 1),
c AS (SELECT asset, CAST(least(floor((r - lo) / w), 149) AS INTEGER) AS bin, count(*) AS cnt FROM rr JOIN sp USING (asset) GROUP BY 1, 2),
b AS (SELECT sp.*, CAST(g AS INTEGER) AS bin, lo + (g + 0.5::DOUBLE) * w AS x FROM sp, (SELECT unnest(range(150)) AS g) t)
SELECT asset, bin, round(x, 6) + 0.0 AS centre, coalesce(cnt, 0) AS count, round(coalesce(cnt, 0) / (n * w), 6) AS density,
 round(exp(-pow((x - mu) / sd, 2) / 2) / (sd * sqrt(2 * pi())), 6) AS normal_density FROM b LEFT JOIN c USING (asset, bin)""",
)
def return_histogram(spark, sf):
    return rounded(explore.return_histogram(ds.frozen_panel(spark, sf)))


@query(
    "return_moments",
    q.keyed(RR + """, g AS (SELECT asset, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, stddev_samp(r) * sqrt(365) AS annual_vol,
 skewness(r) AS skew, kurtosis(r) AS excess_kurtosis, min(r) AS min, max(r) AS max FROM rr GROUP BY 1)""",
            {c: c for c in ("mean", "std", "annual_vol", "skew", "excess_kurtosis", "min", "max")}, "g", keys="asset, n"),
)
def return_moments(spark, sf):
    return rounded(explore.return_moments(ds.panel(spark, sf)))


@query(
    "pairwise_correlation",
    "WITH " + RR + """ SELECT a.asset AS asset_a, b.asset AS asset_b, round(corr(a.r, b.r), 6) AS corr, count(*) AS overlap
 FROM rr a JOIN rr b ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2""",
)
def pairwise_correlation(spark, sf):
    return rounded(explore.pairwise_correlation(ds.panel(spark, sf)))


ROLLCORR = RR + """,
days AS (SELECT DISTINCT date FROM rr),
nm AS (SELECT DISTINCT asset FROM bars), pr AS (SELECT x.asset AS asset_a, y.asset AS asset_b FROM nm x JOIN nm y ON x.asset < y.asset),
g AS (SELECT days.date, asset_a, asset_b, a.r AS x, b.r AS y FROM days CROSS JOIN pr LEFT JOIN rr a ON a.date = days.date AND a.asset = asset_a
  LEFT JOIN rr b ON b.date = days.date AND b.asset = asset_b),
rc AS (SELECT date, asset_a, asset_b, """ + q.corr("x", "y", 90, "asset_a, asset_b").replace(">= 90", ">= 60") + """ AS corr FROM g)"""


@query("rolling_correlation", q.keyed(ROLLCORR, {"corr": "corr"}, "rc", keys="date, asset_a, asset_b"))
def rolling_correlation(spark, sf):
    panel = ds.frozen_panel(spark, sf)
    return rounded(explore.rolling_correlation(panel, explore.asset_names(panel)))


@query(
    "rolling_correlation_summary",
    "WITH " + ROLLCORR + """ SELECT asset_a, asset_b, count(corr) AS count, round(avg(corr), 6) + 0.0 AS mean, round(stddev_samp(corr), 6) AS std, round(min(corr), 6) AS min,
 round(quantile_cont(corr, 0.25), 6) + 0.0 AS q25, round(quantile_cont(corr, 0.5), 6) + 0.0 AS q50, round(quantile_cont(corr, 0.75), 6) + 0.0 AS q75, round(max(corr), 6) AS max FROM rc GROUP BY 1, 2""",
)
def rolling_correlation_summary(spark, sf):
    panel = ds.frozen_panel(spark, sf)
    rc = explore.rolling_correlation(panel, explore.asset_names(panel))
    return rounded(explore.describe_values(rc, ["asset_a", "asset_b"], "corr"))


ACF = RR + """,
tx AS (SELECT asset, 'r' AS kind, date, r AS x FROM rr UNION ALL SELECT asset, 'abs', date, abs(r) FROM rr UNION ALL SELECT asset, 'sq', date, r * r FROM rr),
dx AS (SELECT asset, kind, row_number() OVER (PARTITION BY asset, kind ORDER BY date) AS i, x - avg(x) OVER (PARTITION BY asset, kind) AS d FROM tx),
g0 AS (SELECT asset, kind, count(*) AS n, sum(d * d) AS s FROM dx GROUP BY 1, 2),
ac AS (SELECT a.asset, a.kind, CAST(k AS INTEGER) AS lag, sum(a.d * b.d) AS s FROM dx a, (SELECT unnest(range(1, 41)) AS k) t, dx b
  WHERE b.asset = a.asset AND b.kind = a.kind AND b.i = a.i - k GROUP BY 1, 2, 3),
af AS (SELECT asset, kind, n, lag, ac.s / g0.s AS acf, 1.96 / sqrt(n) AS band FROM ac JOIN g0 USING (asset, kind))"""


@query("acf", q.keyed(ACF, {"acf": "acf", "band": "band"}, "af", keys="asset, kind, n, lag"))
def acf(spark, sf):
    return rounded(explore.acf(ds.panel(spark, sf)))


@query(
    "acf_summary",
    q.keyed(ACF, {"max_abs": "max(abs(acf))", "band": "max(band)", "ratio": "max(abs(acf)) / max(band)"},
            "af WHERE lag <= 21 GROUP BY asset, kind", keys="asset, kind"),
)
def acf_summary(spark, sf):
    return rounded(explore.acf_summary(explore.acf(ds.panel(spark, sf))))


@query(
    "ljung_box",
    q.keyed(ACF + ", h AS (SELECT unnest([5, 10, 21]) AS horizon)",
            {"q_stat": "max(n) * (max(n) + 2) * sum(acf * acf / (n - lag))"},
            "af JOIN h ON lag <= horizon GROUP BY asset, kind, horizon", 4, keys="asset, kind, horizon"),
)
def ljung_box(spark, sf):
    return rounded(explore.ljung_box(explore.acf(ds.panel(spark, sf)), p_values=False), 4)


@query("ljung_box_counts")
def ljung_box_counts(spark, sf):
    return explore.ljung_box_counts(explore.ljung_box(explore.acf(ds.panel(spark, sf))))


@query("pacf")
def pacf(spark, sf):
    return rounded(explore.pacf(explore.acf(ds.panel(spark, sf))))


@query(
    "pacf_first_lags",
    q.keyed(ACF + """,
r12 AS (SELECT asset, kind, max(acf) FILTER (WHERE lag = 1) AS a, max(acf) FILTER (WHERE lag = 2) AS b FROM af GROUP BY 1, 2),
pa AS (SELECT asset, kind, 1::INTEGER AS lag, a AS p FROM r12 UNION ALL SELECT asset, kind, 2, (b - a * a) / (1 - a * a) FROM r12)""",
            {"pacf": "p"}, "pa", keys="asset, kind, lag"),
)
def pacf_first_lags(spark, sf):
    """The lags with a closed form."""
    out = explore.pacf(explore.acf(ds.panel(spark, sf))).filter("lag IN (1, 2)")
    return rounded(out.select("asset", "kind", "lag", "pacf"))


KPSS = RR + """,
dx AS (SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date) AS i, r - avg(r) OVER (PARTITION BY asset) AS d FROM rr),
cs AS (SELECT asset, sum(d) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM dx),
et AS (SELECT asset, sum(s * s) AS eta, count(*) AS n FROM cs GROUP BY 1),
g1 AS (SELECT a.asset, k, sum(a.d * b.d) AS g FROM dx a, (SELECT unnest(range(0, 10)) AS k) t, dx b WHERE b.asset = a.asset AND b.i = a.i - k GROUP BY 1, 2),
s AS (SELECT asset, max(n) AS n, max(eta) AS eta, sum(CASE WHEN k = 0 THEN g ELSE 2 * g END) FILTER (WHERE k <= floor(pow(n, 2.0 / 9))) / max(n) AS s0,
  sum(2 * k * g) FILTER (WHERE k <= floor(pow(n, 2.0 / 9))) / max(n) AS s1 FROM g1 JOIN et USING (asset) GROUP BY 1),
l AS (SELECT *, CAST(least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS INTEGER) AS lags FROM s),
ks AS (SELECT asset, lags, unnest(range(0, lags + 1)) AS k FROM l),
g AS (SELECT a.asset, k, sum(a.d * b.d) AS g FROM ks JOIN dx a ON a.asset = ks.asset JOIN dx b ON b.asset = a.asset AND b.i = a.i - k GROUP BY 1, 2),
k AS (SELECT l.asset, lags, max(eta) / pow(max(n), 2) / (sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lags + 1.0)) * g END) / max(n)) AS st
  FROM g JOIN l USING (asset) GROUP BY 1, 2)"""


@query("kpss", q.keyed(KPSS, {"kpss_stat": "st"}, "k", keys="asset, lags"))
def kpss(spark, sf):
    return rounded(explore.kpss(ds.panel(spark, sf)).drop("kpss_pvalue"))


@query("stationarity")
def stationarity(spark, sf):
    return rounded(explore.stationarity(ds.frozen_panel(spark, sf)))


# -- audits ------------------------------------------------------------------------------

AUDITED = ("px_ret_21", "px_ret_std_63", "px_cumret_90", "px_ret_kurt_21")


@query(
    "causality_audit",
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in AUDITED) + "]) AS feature, 0.0::DOUBLE AS max_diff, 0::BIGINT AS n_mismatch",
)
def causality_audit(spark, sf):
    return audit.causality_audit(features.add_price, ds.frozen_panel(spark, sf), "1999-06-30", AUDITED)


SCREENED = ("ret_lag1", "volume", "quote_volume", "high", "close")
TARGETED = ("ret_1d", "dir_1d", "vol_1d", "close")


@query(
    "leak_screen",
    "WITH " + q.TARGETS + ", c AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{t}' AS target, abs(corr({f}, {t})) AS c FROM m" for f in SCREENED for t in TARGETED)
    + ") SELECT feature, target, round(c, 6) AS abs_corr, c > 0.999 AS flagged FROM c",
)
def leak_screen(spark, sf):
    m = add_targets(add_meta(ds.panel(spark, sf)))
    out = audit.leak_screen(m.select(*SCREENED, "ret_1d", "dir_1d", "vol_1d"), SCREENED, TARGETED)
    return rounded(out)
