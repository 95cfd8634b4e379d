"""GARCH over blocks against the recursion over whole series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import timeseries, variance_blocks
from barloom.operators.blocks import number_rows


def simulated(n, seed, a=0.08, b=0.88):
    rng = np.random.default_rng(seed)
    h, out = 1e-4, []
    for _ in range(n):
        r = np.sqrt(h) * rng.standard_t(7) / np.sqrt(7 / 5)
        out.append(r)
        h = 1e-4 * (1 - a - b) + a * r * r + b * h
    return out


def frame(asset, values, n_train):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=k) for k in range(len(values))]
    split = ["train"] * n_train + ["test"] * (len(values) - n_train)
    return pd.DataFrame({"fold": 0, "asset": asset, "date": days, "split": split, "ret_lag1": values})


@pytest.fixture(scope="module")
def rows(spark):
    gaps = simulated(900, 2)
    for k in (700, 701, 702, 755, 830):
        gaps[k] = None
    gaps[10] = None  # an empty training day takes no part
    parts = [
        frame("long", simulated(1500, 1), 1300), frame("gaps", gaps, 700), frame("short", simulated(120, 3), 100),
        frame("flat", [0.0] * 500, 400),
    ]
    schema = "fold int, asset string, date date, split string, ret_lag1 double"
    table = pd.concat(parts).astype(object)
    return spark.createDataFrame(table.where(table.notna(), None), schema).cache()


def numbered(rows):
    kept = rows.filter("split = 'test' OR ret_lag1 IS NOT NULL")
    return number_rows(kept, ("fold", "asset"), ("date",), F.date_trunc("month", "date"))


@pytest.mark.parametrize("block_rows", [150, 100_000])
def test_blocks_equal_the_sequential_recursion(rows, block_rows):
    got = variance_blocks.variance_paths(numbered(rows), block_rows=block_rows).toPandas()
    want = timeseries.variance_paths(rows, "garch11").toPandas()
    assert len(got) == len(want)
    both = got.merge(want, on=["fold", "asset", "date", "split"], suffixes=("", "_s"))
    assert len(both) == len(want) and (both["fitted"] == both["fitted_s"]).all()
    assert set(both.loc[both["fitted"], "asset"]) == {"long", "gaps"}
    for c in ("h_now", "h_next", "fallback"):
        x, y = both[c].to_numpy(float), both[f"{c}_s"].to_numpy(float)
        assert np.array_equal(np.isnan(x), np.isnan(y))
        worst = np.nanmax(np.abs(x / y - 1))
        assert worst < 1e-12, (c, worst)


def test_an_empty_table_gives_no_rows(spark, rows):
    assert variance_blocks.variance_paths(numbered(rows.limit(0))).count() == 0


def test_search_settles(monkeypatch):
    e = np.array(simulated(1500, 5))

    def loglik(found):
        a, b, nu = found
        h = timeseries.variance_path(e, float(np.mean(e**2)), "garch11", np.array([a]), np.array([b]))[:-1]
        return float(timeseries.squared_t_loglik(e**2, h, nu)[0])

    once = loglik(timeseries.fit_variance(e, "garch11"))

    def doubled(v):
        return tuple(sorted({*v, *[(x + y) / 2 for x, y in zip(v, v[1:])]}))

    monkeypatch.setattr(timeseries, "PERSISTENCE", doubled(timeseries.PERSISTENCE))
    monkeypatch.setattr(timeseries, "TAILS", doubled(timeseries.TAILS))
    monkeypatch.setattr(timeseries, "REACTION", {k: doubled(v) for k, v in timeseries.REACTION.items()})
    assert abs(loglik(timeseries.fit_variance(e, "garch11")) - once) < 0.02
