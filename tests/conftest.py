import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.plans.session import local_session  # noqa: E402
from barloom.schema import PANEL_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", "4g")


def make_panel(assets=("BTC", "ETH", "LTC"), days=260, seed=7, gaps=0.0):
    rng = np.random.default_rng(seed)
    frames = []
    for asset in assets:
        close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.03, days)))
        open_ = np.r_[100.0, close[:-1]]
        high = np.maximum(open_, close) * (1 + rng.uniform(0.001, 0.02, days))
        low = np.minimum(open_, close) * (1 - rng.uniform(0.001, 0.02, days))
        volume = rng.lognormal(5, 0.4, days)
        frame = pd.DataFrame(
            {
                "asset": asset, "date": pd.date_range("2018-01-01", periods=days).date, "open": open_,
                "high": high, "low": low, "close": close, "volume": volume, "quote_volume": volume * close,
                "trades": rng.integers(1000, 5000, days),
                "taker_buy_quote_volume": volume * close * rng.uniform(0.3, 0.7, days), "source": "synthetic",
            }
        )
        frames.append(frame[rng.random(days) >= gaps])
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def panel_pdf():
    return make_panel()


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    return spark.createDataFrame(panel_pdf, PANEL_SCHEMA).cache()


@pytest.fixture(scope="session")
def gapped(spark):
    return spark.createDataFrame(make_panel(gaps=0.15, seed=3), PANEL_SCHEMA).cache()


@pytest.fixture(scope="session")
def golden(spark):
    rows = []
    for asset, closes in {"BTC": [100, 110, 105, 105, 120], "ETH": [1000, 900, 950, 1000, 1100]}.items():
        for i, c in enumerate(closes):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
            rows.append((asset, day, float(c), 1.02 * c, 0.98 * c, float(c), 1000.0, 1000.0 * c, 100, 500.0 * c, "golden"))
    return spark.createDataFrame(rows, PANEL_SCHEMA)


def table(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
