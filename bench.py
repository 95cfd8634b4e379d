"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from barloom.plans import catalog
from barloom.plans.session import local_session

HEADLINE = (
    "daily_bars",
    "targets",
    "price_features",
    "volume_features",
    "range_vol_features",
    "technical_features",
    "cross_section",
    "aux_onchain",
    "intraday_blocks",
    "folds_expanding",
    "split_membership",
    "scaler_fit",
    "baselines_direction",
    "baselines_volatility",
    "classification_metrics",
    "dm_volatility",
    "cost_sweep",
    "acf",
    "ridge_one_feature",
    "garch_volatility",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    catalog.QUERIES["daily_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(match.group(1)) if match else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
