"""SQL equivalents of folds, baselines, predictions and backtests (DuckDB dialect)."""

from __future__ import annotations

from barloom.functions import normal
from barloom.plans import datasets as ds
from barloom.plans import sqltext as q


def rows(primary: str) -> str:
    """``mm``: modelling rows after warmup."""
    return q.TARGETS + f""",
mm AS (SELECT * FROM m WHERE i >= {ds.WARMUP} AND {primary} IS NOT NULL)"""


def folds(primary: str, plan=ds.EXPANDING) -> str:
    ws = f"DATE '{plan.train_start}'"
    if plan.scheme == "rolling":
        ws = f"greatest({ws}, CAST(ts - INTERVAL {plan.rolling_train_years} YEAR AS DATE))"
    return rows(primary) + f""",
pd AS (SELECT date, count(*) AS n FROM mm GROUP BY date),
cand AS (SELECT CAST(ts AS DATE) AS ts, CAST(ts + INTERVAL {plan.test_months} MONTH AS DATE) AS te,
   CAST(ts AS DATE) - {plan.horizon} AS purge, CAST(ts AS DATE) - {plan.gap_days} AS embargo, {ws} AS ws
 FROM (SELECT unnest(generate_series(TIMESTAMP '{plan.first_test_start}',
   (SELECT max(date) FROM pd)::TIMESTAMP, INTERVAL {plan.step_months} MONTH)) AS ts) t
 WHERE ts < (SELECT max(date) FROM pd)),
reach AS (SELECT cand.*, pd.date, pd.n FROM cand JOIN pd ON pd.date >= ws AND pd.date < te),
cuts AS (SELECT ts, list(date ORDER BY date) FILTER (WHERE date < embargo) AS d FROM reach GROUP BY ts),
cut2 AS (SELECT ts, d[1 + CAST(floor(len(d) * {1.0 - plan.inner_val_frac}::DOUBLE) AS BIGINT)] AS val_cut FROM cuts),
rc AS (SELECT reach.*, val_cut, val_cut - {plan.gap_days} AS inn FROM reach JOIN cut2 USING (ts)),
ff AS (SELECT ts, te, purge, embargo, ws, val_cut, inn,
  coalesce(sum(n) FILTER (WHERE date < embargo), 0) AS n_full,
  coalesce(sum(n) FILTER (WHERE date < inn), 0) AS n_train,
  coalesce(sum(n) FILTER (WHERE date < embargo AND date >= val_cut), 0) AS n_val,
  coalesce(sum(n) FILTER (WHERE date >= ts), 0) AS n_test,
  coalesce(sum(n) FILTER (WHERE date >= purge AND date < ts), 0) AS n_purged,
  coalesce(sum(n) FILTER (WHERE date >= embargo AND date < purge), 0) AS n_embargoed,
  min(date) FILTER (WHERE date < inn) AS train_start, max(date) FILTER (WHERE date < inn) AS train_end,
  min(date) FILTER (WHERE date < embargo AND date >= val_cut) AS val_start,
  max(date) FILTER (WHERE date < embargo AND date >= val_cut) AS val_end,
  min(date) FILTER (WHERE date >= ts) AS test_start, max(date) FILTER (WHERE date >= ts) AS test_end
 FROM rc GROUP BY ALL),
folds AS (SELECT CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS fold, * FROM ff
  WHERE n_full >= {plan.min_train_rows} AND n_test > 0)"""


def membership(primary: str, plan=ds.EXPANDING) -> str:
    return folds(primary, plan) + """,
mem AS (SELECT * FROM (SELECT fold, CASE WHEN date >= ts THEN 'test'
    WHEN date >= val_cut AND date < embargo THEN 'val' WHEN date < inn THEN 'train' END AS split, mm.*
  FROM mm JOIN folds ON date >= folds.ws AND date < folds.te) z WHERE split IS NOT NULL)"""


def _horner(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def phi(x: str) -> str:
    """Normal CDF, the same rational approximation as the column expression."""
    z = f"least(abs({x}), 37.0::DOUBLE)"
    fraction = z
    for k in range(normal.TAIL_TERMS, 0, -1):
        fraction = f"({z} + {k}::DOUBLE / {fraction})"
    density = f"exp(-{z} * {z} / 2)"
    near = f"{density} * {_horner(z, normal.NUMERATOR)} / {_horner(z, normal.DENOMINATOR)}"
    far = f"{density} / {fraction} / {normal.ROOT_TWO_PI}::DOUBLE"
    tail = f"(CASE WHEN {z} < {normal.SPLIT}::DOUBLE THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def _te(x: str, minp: int, part="fold, asset") -> str:
    return q.roll("avg", x, 63, minp, part)


def direction() -> str:
    """``pr``: direction predictions of every baseline."""
    return membership("dir_1d") + f""",
fs AS (SELECT fold, stddev_samp(ret_lag1) AS sigma, avg(ret_lag1) AS mean, avg(dir_1d) AS rate
  FROM mem WHERE split = 'train' GROUP BY fold),
te AS (SELECT t.*, sigma, mean, rate, coalesce(ret_lag1, 0) AS last FROM mem t JOIN fs USING (fold) WHERE split = 'test'),
tr AS (SELECT *, coalesce({_te("ret_lag1", 5)}, mean) AS trail FROM te),
pr AS (SELECT asset, date, 0.5::DOUBLE AS pred, 0.5::DOUBLE AS proba, 'zero' AS model, fold, dir_1d AS y_true FROM tr
 UNION ALL SELECT asset, date, CASE WHEN last > 0 THEN 1 ELSE 0 END, {phi("(last / sigma)")}, 'persistence', fold, dir_1d FROM tr
 UNION ALL SELECT asset, date, CASE WHEN trail > 0 THEN 1 ELSE 0 END,
   {phi("(trail / (sigma / sqrt(63)))")}, 'historical_mean', fold, dir_1d FROM tr
 UNION ALL SELECT asset, date, CASE WHEN rate >= 0.5 THEN 1 ELSE 0 END, rate, 'majority_class', fold, dir_1d FROM tr)"""


def returns() -> str:
    return membership("ret_1d") + f""",
fs AS (SELECT fold, avg(ret_lag1) AS mean FROM mem WHERE split = 'train' GROUP BY fold),
te AS (SELECT t.*, mean, coalesce(ret_lag1, 0) AS last FROM mem t JOIN fs USING (fold) WHERE split = 'test'),
tr AS (SELECT *, coalesce({_te("ret_lag1", 5)}, mean) AS trail FROM te),
pr AS (SELECT asset, date, 0.0::DOUBLE AS pred, 'zero' AS model, fold, ret_1d AS y_true FROM tr
 UNION ALL SELECT asset, date, last, 'persistence', fold, ret_1d FROM tr
 UNION ALL SELECT asset, date, trail, 'historical_mean', fold, ret_1d FROM tr)"""


def volatility() -> str:
    """``pr``: log-variance predictions of the four volatility baselines."""
    w = "PARTITION BY fold, asset ORDER BY date"
    hist = f"list(v) FILTER (WHERE v IS NOT NULL) OVER ({w} ROWS UNBOUNDED PRECEDING)"
    return membership("vol_1d") + f""",
lv AS (SELECT *, CASE WHEN realised_var_now > 0 THEN realised_var_now END AS v,
   CASE WHEN realised_var_now > 0 THEN ln(realised_var_now) END AS l FROM mem),
fs AS (SELECT fold, quantile_cont(l, 0.5) AS med, avg(l) AS mean, ln(avg(v)) AS lev
   FROM lv WHERE split = 'train' GROUP BY fold),
te AS (SELECT t.*, med, mean, lev FROM lv t JOIN fs USING (fold) WHERE split = 'test'),
tl AS (SELECT *, row_number() OVER (PARTITION BY fold, asset, split ORDER BY date DESC) AS back
   FROM lv WHERE split IN ('train', 'test')),
tm AS (SELECT fold, asset, date, split, {_te("v", 10)} AS p FROM tl WHERE split = 'test' OR back <= 63),
ew AS (SELECT fold, asset, date, split, list_reduce({hist}, lambda a, x: 0.94::DOUBLE * a + (1 - 0.94::DOUBLE) * x) AS p
   FROM tl WHERE split = 'test' OR back <= 250),
pr AS (SELECT asset, date, coalesce(l, med) AS pred, 'vol_persistence' AS model, fold, vol_1d AS y_true FROM te
 UNION ALL SELECT asset, date, coalesce({_te("l", 10)}, mean), 'vol_climatology', fold, vol_1d FROM te
 UNION ALL SELECT te.asset, te.date, coalesce(ln(greatest(p, 1e-12)), lev), 'vol_trailing_mean', te.fold, vol_1d
   FROM te JOIN tm ON te.fold = tm.fold AND te.asset = tm.asset AND te.date = tm.date AND tm.split = 'test'
 UNION ALL SELECT te.asset, te.date, coalesce(ln(greatest(p, 1e-12)), lev), 'vol_ewma', te.fold, vol_1d
   FROM te JOIN ew ON te.fold = ew.fold AND te.asset = ew.asset AND te.date = ew.date AND ew.split = 'test')"""


def seeded() -> str:
    """``ps``: direction predictions with two pseudo seeds, probabilities +-0.01."""
    return direction() + """,
ps AS (SELECT asset, date, pred, proba + (2 * seed - 1) * 0.01::DOUBLE AS proba, model, fold, seed, y_true
  FROM pr CROSS JOIN (SELECT unnest([0, 1]) AS seed) s)"""


CLASS_COLS = [
    "directional_accuracy", "base_rate", "balanced_accuracy", "matthews_corrcoef", "roc_auc", "brier_score",
]


def class_metrics(frm: str, by: str, name: str = "cm") -> str:
    """Classification metrics per group; AUC through average ranks."""
    keys = [k.strip() for k in by.split(",")]
    return f""",
{name}_r AS (SELECT {by}, y_true > 0 AS up, proba AS s,
   rank() OVER (PARTITION BY {by} ORDER BY proba) + (count(*) OVER (PARTITION BY {by}, proba) - 1) / 2.0 AS rk
   FROM {frm} WHERE y_true IS NOT NULL AND proba IS NOT NULL),
{name}_c AS (SELECT {by}, count(*) AS n_obs,
   count(*) FILTER (WHERE up AND s >= 0.5)::DOUBLE AS tp, count(*) FILTER (WHERE NOT up AND s < 0.5)::DOUBLE AS tn,
   count(*) FILTER (WHERE NOT up AND s >= 0.5)::DOUBLE AS fp, count(*) FILTER (WHERE up AND s < 0.5)::DOUBLE AS fn,
   avg(pow(s - CASE WHEN up THEN 1 ELSE 0 END, 2)) AS brier, sum(rk) FILTER (WHERE up) AS ru
   FROM {name}_r GROUP BY {by}),
{name} AS (SELECT {", ".join(keys)}, n_obs, {", ".join(
    f"CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN {e} END AS {c}" for c, e in zip(CLASS_COLS, [
        "(tp + tn) / n_obs", "(tp + fn) / n_obs", "(tp / (tp + fn) + tn / (tn + fp)) / 2",
        "CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END",
        "(ru - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (tn + fp))", "brier"]))}
   FROM {name}_c)"""


def dm_sql(by: str, frm: str, loss: str, extra: str = "") -> str:
    """Diebold-Mariano at horizon 1 from a relation with y, a, b."""
    la, lb = {
        "squared": ("pow(y - a, 2)", "pow(y - b, 2)"),
        "qlike": ("(y / a - ln(y / a) - 1)", "(y / b - ln(y / b) - 1)"),
    }[loss]
    keys = f"{by}, " if by else ""
    return f""",
dmg AS (SELECT {keys} count(*) AS n_obs, avg({la} - {lb}) AS md, var_pop({la} - {lb}) AS g0,
   bool_and(a = b) AS same FROM {frm} WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY {by}),
dm AS (SELECT *, CASE WHEN n_obs >= 5 AND NOT same AND g0 > 0
   THEN md / sqrt(g0 / n_obs) * sqrt((n_obs - 1.0) / n_obs) END AS stat FROM dmg)"""


DM_BETTER = "CASE WHEN stat IS NULL OR md = 0 THEN 'tie' WHEN md < 0 THEN 'a' ELSE 'b' END"

# -- backtest ---------------------------------------------------------------------


def positions() -> str:
    """``po``: seed-averaged long-short positions with forward returns."""
    return seeded() + """,
sa AS (SELECT model, asset, date, avg(proba) AS s FROM ps GROUP BY ALL),
po AS (SELECT sa.model, sa.asset, sa.date, CASE WHEN s > 0.52 THEN 1.0 WHEN s < 0.48 THEN -1.0 ELSE 0.0 END::DOUBLE AS position,
   m.fwd_ret_simple AS forward_return FROM sa LEFT JOIN m ON m.asset = sa.asset AND m.date = sa.date)"""


def book(src: str, run: str, pos: str = "position", name: str = "bk") -> str:
    own = run if "asset" in run else f"{run}, asset"
    return f""",
{name}0 AS (SELECT *, {pos} AS p FROM {src} WHERE forward_return IS NOT NULL),
{name}1 AS (SELECT *, sum(CASE WHEN p <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {run}, date) AS na FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN na > 0 THEN p / na ELSE 0 END AS wt FROM {name}1),
{name} AS (SELECT *, abs(p - coalesce(lag(p) OVER (PARTITION BY {own} ORDER BY date), 0)) AS turn,
   abs(wt - coalesce(lag(wt) OVER (PARTITION BY {own} ORDER BY date), 0)) AS wturn FROM {name}2),
{name}d AS (SELECT {run}, date, sum(wt * forward_return) AS gross, sum(wturn) AS turnover, max(na) AS na
   FROM {name} GROUP BY {run}, date)"""


def curve(run: str, levels: str, name: str, src: str) -> str:
    return f""",
{name}n AS (SELECT *, gross - turnover * cost_bps / 2 / 1e4 AS net FROM {src} CROSS JOIN (SELECT unnest({levels}) AS cost_bps) c),
{name} AS (SELECT *, product(1 + net) OVER (PARTITION BY {run}, cost_bps ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM {name}n)"""


def stats(run: str, src: str, name: str) -> str:
    key = f"{run}, cost_bps"
    w = f"PARTITION BY {key} ORDER BY date"
    prev = f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f""",
{name}1 AS (SELECT *, greatest(1.0, coalesce(max(equity) OVER ({w} {prev}), 1.0)) AS pk FROM {src}),
{name}2 AS (SELECT *, equity >= pk AS atp, greatest(pk, equity) AS top FROM {name}1),
{name}3 AS (SELECT *, date - coalesce(last_value(CASE WHEN atp THEN date END IGNORE NULLS) OVER ({w} {prev}),
    first_value(date) OVER ({w})) AS since, NOT coalesce(lag(atp) OVER ({w}), true) AS wasu FROM {name}2),
{name}g AS (SELECT {key}, count(*) AS n_periods, arg_max(equity, date) - 1 AS tr, stddev_samp(net) AS sd, avg(net) AS mean,
   sqrt(avg(pow(least(net, 0), 2))) AS down, min(equity / top - 1) AS mdd,
   coalesce(max(since) FILTER (WHERE atp AND wasu), 0) AS closed,
   CASE WHEN arg_max(atp, date) THEN NULL ELSE arg_max(since, date) END AS opn,
   count(*) FILTER (WHERE na > 0) AS held, count(*) FILTER (WHERE na > 0 AND net > 0) AS wins,
   avg(net) FILTER (WHERE na > 0 AND net > 0) AS aw, avg(net) FILTER (WHERE na > 0 AND net < 0) AS al, avg(turnover) AS turn
   FROM {name}3 GROUP BY {key}),
{name} AS (SELECT {key}, tr AS total_return, CASE WHEN 1 + tr > 0 THEN pow(1 + tr, 365.0 / n_periods) - 1 END AS annual_return,
   sd * sqrt(365) AS annual_vol, CASE WHEN sd > 0 THEN mean / sd * sqrt(365) END AS sharpe,
   CASE WHEN n_periods > 1 AND down > 0 THEN mean / down * sqrt(365) END AS sortino, mdd AS max_drawdown,
   CAST(greatest(closed, coalesce(opn, 0)) AS BIGINT) AS max_drawdown_days, coalesce(opn >= closed, false) AS max_drawdown_unrecovered,
   CASE WHEN mdd < 0 AND 1 + tr > 0 THEN (pow(1 + tr, 365.0 / n_periods) - 1) / abs(mdd) END AS calmar,
   held::DOUBLE / n_periods AS exposure, CASE WHEN held > 0 THEN wins::DOUBLE / held END AS hit_rate, aw AS avg_win, al AS avg_loss,
   abs(aw / al) AS win_loss_ratio, turn * 365 AS annual_turnover, n_periods FROM {name}g)"""


STAT_DOUBLES = [
    "total_return", "annual_return", "annual_vol", "sharpe", "sortino", "max_drawdown", "calmar",
    "exposure", "hit_rate", "avg_win", "avg_loss", "win_loss_ratio", "annual_turnover",
]


def stat_select(run: str, src: str, strategy: str, cost: str = "cost_bps") -> str:
    doubles = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in STAT_DOUBLES)
    return (
        f"SELECT {run}, CAST({cost} AS DOUBLE) AS cost_bps, '{strategy}' AS strategy, {doubles}, "
        f"max_drawdown_days, max_drawdown_unrecovered, n_periods FROM {src}"
    )


def sweep(run: str) -> str:
    return (
        "WITH " + positions() + book("po", run) + curve(run, "[0.0, 5.0, 20.0]", "cv", "bkd") + stats(run, "cv", "st")
        + book("po", run, "1.0::DOUBLE", "bh") + curve(run, "[0.0]", "hv", "bhd") + stats(run, "hv", "sh")
        + " " + stat_select(run, "st", "model") + " UNION ALL " + stat_select(run, "sh", "buy_and_hold", "NULL")
    )
