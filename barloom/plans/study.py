"""A study that can be stopped and resumed: families of forecasters, a ledger of finished fits, and their tables.

A task is (model, fold, seed); the pooled and the per-asset arm of a family are two models.  A family fits all its open tasks
in shared jobs, writes what it forecast under a new attempt and then appends one ledger row per task that names
the attempt.  Only attempts in the ledger are read, so a run that stops between the two leaves nothing behind that counts,
and starting again fits just the tasks the ledger lacks.  A family that raises is tried fold by fold; folds that raise again become
ledger rows with the message.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import baselines, boosting, compare, lagged, linear, metrics, timeseries
from barloom.operators.linear import SUFFIX

LEDGER = "model string, fold int, seed int, status string, message string, attempt string, n_rows long, seconds double"
GAINS = "model string, fold int, seed int, feature string, gain double"
DONE, SKIPPED, FAILED = "done", "skipped", "failed"
SEEDS = (0, 1, 2, 3, 4)


@dataclass(frozen=True)
class Data:
    """What families fit on: fold members with their columns, scaled design rows, feature names, the target."""

    members: DataFrame
    rows: DataFrame
    names: Sequence[str]
    target: str

    def only(self, folds: Sequence[int]) -> Data:
        mine = F.col("fold").isin([int(f) for f in folds])
        return replace(self, members=self.members.filter(mine), rows=self.rows.filter(mine))


@dataclass(frozen=True)
class Family:
    """``fit(data)`` gives forecasts of all models and folds, and gains or None."""

    name: str
    models: tuple[str, ...]
    fit: Callable[[Data], tuple[DataFrame, DataFrame | None]]
    seeds: tuple[int | None, ...] = (None,)


def linear_family(data: Data):
    """Ridge, or logistic for direction, in both scopes."""
    logistic = data.target == "dir_1d"
    if logistic:
        pooled, own = linear.fit_logistic_pooled(data.rows, len(data.names)), linear.fit_logistic_per_asset(data.rows)
    else:
        pooled, own = linear.fit_ridge_pooled(data.rows), linear.fit_ridge_per_asset(data.rows)
    pooled, own = pooled.persist(), own.persist()
    arms = [linear.predict(data.rows, c, m, data.target, logistic) for c, m in ((pooled, "ridge"), (own, "ridge" + SUFFIX))]
    gains = [linear.importance(c, data.names, m).withColumn("seed", F.lit(None).cast("int")) for c, m in ((pooled, "ridge"), (own, "ridge" + SUFFIX))]
    return arms[0].unionByName(arms[1]), gains[0].unionByName(gains[1])


def _boosted(data: Data):
    found, gains = boosting.fit_predict(data.rows, data.names, "boosted_trees", data.target, SEEDS, data.target == "dir_1d")
    return found, gains.groupBy("model", "fold", "seed", "feature").agg(F.avg("gain").alias("gain"))


def _windowed(data: Data):
    return lagged.predict(data.rows, lagged.fit(data.rows), "dlinear", data.target), None


def families_for(target: str) -> list[Family]:
    both = lambda name: (name, name + SUFFIX)
    out = [
        Family("baselines", tuple(baselines.BASELINES[target]), lambda d: (baselines.baselines_for(d.members, d.target), None)),
        Family("ridge", both("ridge"), linear_family),
        Family("boosted_trees", both("boosted_trees"), _boosted, SEEDS),
        Family("dlinear", both("dlinear"), _windowed),
    ]
    if target == "vol_1d":
        for variant in ("garch11", "egarch11"):
            out.append(Family(variant, (variant,), lambda d, v=variant: (timeseries.variance_predictions(d.members, v), None)))
    else:
        out.append(Family("arma", ("arima",), lambda d: (timeseries.arma_predictions(d.members, d.target), None)))
    return out


class Store:
    """Forecasts and gains by attempt, and the ledger, below one folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str, run_id: str):
        self.spark, self.base = spark, f"{base}/{run_id}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")
        except PySparkException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.base}/ledger")

    def write(self, name: str, frame: DataFrame, attempt: str) -> None:
        frame.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.base}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        """Rows of the attempts that the ledger names for their task."""
        told = self.ledger().filter(F.col("status") != FAILED).select("model", "fold", F.col("seed").alias("of_seed"), "attempt")
        rows = self._read(name, schema + ", attempt string")
        same = ["model", "fold", "attempt"]
        # one ledger row per model, fold and seed
        return rows.join(F.broadcast(told), same).filter(F.col("seed").eqNullSafe(F.col("of_seed"))).drop("attempt", "of_seed")


FORECASTS = "asset string, date date, pred double, proba double, model string, fold int, seed int, target string, y_true double"


def _attempt(store: Store, data: Data, family: Family, folds: Sequence[int], wanted: set[tuple]) -> None:
    attempt, begun = uuid.uuid4().hex, time.perf_counter()
    forecasts, gains = family.fit(data.only(folds))
    names = [c.split()[0] for c in FORECASTS.split(", ")]
    store.write("forecasts", forecasts.select(*names).withColumn("seed", F.col("seed").cast("int")), attempt)
    if gains is not None:
        store.write("gains", gains.select(*[c.split()[0] for c in GAINS.split(", ")]), attempt)
    written = store._read("forecasts", FORECASTS + ", attempt string").filter(F.col("attempt") == attempt)
    counts = {
        (r.model, r.fold, r.seed): (r.n, r.known)
        for r in written.groupBy("model", "fold", "seed").agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("known")).collect()
    }
    if more := {k[0] for k in counts} - set(family.models):
        raise ValueError(f"{family.name} forecasts models that it does not name: {sorted(more)}")
    seconds = round(time.perf_counter() - begun, 3)
    rows = []
    for model, fold, seed in sorted(wanted, key=str):
        n, fine = counts.get((model, fold, seed), (0, 0))
        rows.append((model, fold, seed, DONE if fine else SKIPPED, None if fine else "no scope of this fold can be fitted", attempt, n, seconds))
    store.append(rows)


def run(store: Store, data: Data, families: Sequence[Family], retry_failed: bool = False) -> None:
    """Fit every task that the ledger lacks."""
    folds = sorted(r["fold"] for r in data.rows.select("fold").distinct().collect())
    for family in families:
        finished = {(r.model, r.fold, r.seed) for r in store.ledger().collect() if not (retry_failed and r.status == FAILED)}
        tasks = {(m, f, s) for m in family.models for f in folds for s in family.seeds} - finished
        if not tasks:
            continue
        mine = lambda f: {t for t in tasks if t[1] == f}
        left = sorted({t[1] for t in tasks})
        try:
            _attempt(store, data, family, left, tasks)
            continue
        except Exception as error:
            if len(left) == 1:
                store.append([(m, f, s, FAILED, str(error)[:500], None, 0, 0.0) for m, f, s in sorted(tasks, key=str)])
                continue
        for fold in left:
            try:
                _attempt(store, data, family, [fold], mine(fold))
            except Exception as error:
                store.append([(m, f, s, FAILED, str(error)[:500], None, 0, 0.0) for m, f, s in sorted(mine(fold), key=str)])


def tables(store: Store, target: str) -> dict[str, DataFrame]:
    """Forecasts, scores, tests, scope comparison and importances of the finished tasks, and the ledger."""
    forecasts, gains = store.read("forecasts", FORECASTS), store.read("gains", GAINS)
    column = "proba" if target == "dir_1d" else "pred"
    base, loss = compare.default_baseline(target), compare.default_loss(target)
    return {
        "predictions": forecasts,
        "results": metrics.score(forecasts, ["model", "fold", "seed"], target),
        "dm": compare.dm_table(forecasts, base, loss, column),
        "dm_per_asset": compare.dm_table(forecasts, base, loss, column, per_asset=True),
        "per_asset": compare.per_asset_results(forecasts, target),
        "scope": compare.scope_comparison(forecasts, column),
        "importance": gains,
        "importance_top": compare.importance_top(gains),
        "importance_rank_stability": compare.rank_stability(gains),
        "ledger": store.ledger(),
    }
