"""Fragments of the SQL equivalents (DuckDB dialect)."""

from __future__ import annotations

TRADE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"

BARS = f"""bars AS (
  SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date,
    first(px ORDER BY {TRADE_ORDER}) AS open, max(px) AS high, min(px) AS low,
    last(px ORDER BY {TRADE_ORDER}) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) AS quote_volume, count(*) AS trades,
    coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 0) AS taker_buy_quote_volume,
    'lineitem' AS source
  FROM (SELECT *, pow(l_extendedprice / l_quantity, 0.05) AS px FROM lineitem) t
  GROUP BY 1, 2)"""

EVENT_BARS = """ebars AS (
  SELECT event_type AS asset, date_trunc('hour', ts) AS date,
    first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts) AS close, sum(value) AS volume, sum(value) AS quote_volume,
    count(*) AS trades, coalesce(sum(value) FILTER (WHERE user_id % 2 = 0), 0) AS taker_buy_quote_volume,
    'events' AS source
  FROM events GROUP BY 1, 2)"""

W = "PARTITION BY asset ORDER BY date"

# Panel with log close and one-row log return.
RET = (
    BARS
    + f""",
r AS (SELECT *, ln(close) AS lc, ln(close) - lag(ln(close)) OVER ({W}) AS r1 FROM bars)"""
)

PK = "pow(ln(high / low), 2) / (4 * ln(2))"

# Panel with targets and meta columns.
TARGETS = (
    RET
    + f""",
v AS (SELECT *, {PK} AS pk FROM r),
m AS (SELECT *, r1 AS ret_lag1, pk AS realised_var_now,
    lead(lc) OVER ({W}) - lc AS ret_1d,
    CASE WHEN lead(lc) OVER ({W}) IS NOT NULL
      THEN CASE WHEN lead(lc) OVER ({W}) - lc > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS dir_1d,
    lead(CASE WHEN pk > 0 THEN pk END) OVER ({W}) AS realised_var_1d,
    ln(lead(CASE WHEN pk > 0 THEN pk END) OVER ({W})) AS vol_1d,
    lead(close) OVER ({W}) / close - 1 AS fwd_ret_simple,
    row_number() OVER ({W}) - 1 AS i
  FROM v)"""
)


def frame(n: int, part: str = "asset", order: str = "date") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"({p}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, minp: int | None = None, part: str = "asset") -> str:
    f = frame(n, part)
    call = f"quantile_cont({x}, 0.5)" if agg == "median" else f"{agg}({x})"
    return f"(CASE WHEN count({x}) OVER {f} >= {minp or n} THEN {call} OVER {f} END)"


def zscore(x: str, n: int, minp: int | None = None, part: str = "asset") -> str:
    sd = roll("stddev_samp", x, n, minp, part)
    return f"(CASE WHEN {sd} > 1e-12 THEN ({x} - {roll('avg', x, n, minp, part)}) / {sd} END)"


def corr(a: str, b: str, n: int, part: str = "asset") -> str:
    f = frame(n, part)
    x = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
    y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
    sx, sy = f"stddev_samp({x}) OVER {f}", f"stddev_samp({y}) OVER {f}"
    return (
        f"(CASE WHEN count({x}) OVER {f} >= {n} AND {sx} > 1e-12 AND {sy} > 1e-12 "
        f"THEN covar_samp({x}, {y}) OVER {f} / ({sx} * {sy}) END)"
    )


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def keyed(ctes: str, cols: dict[str, str], frm: str, digits: int = 6, keys: str = "asset, date") -> str:
    body = ", ".join(rnd(e, n, digits) for n, e in cols.items())
    lead = f"{keys}, " if keys else ""
    return f"WITH {ctes} SELECT {lead}{body} FROM {frm}"
