"""A whole study as one set of lazy tables: folds, forecasts, scores, tests."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import folds, scaling
from barloom.plans import study
from barloom.plans.session import cut_lineage, ensure_checkpoint_dir
from barloom.sources import store


def scale_members(m: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``columns`` in place and materialise; ``m`` should be materialised itself."""
    return cut_lineage(scaling.transform(m, scaling.fit_scaler(m, columns), columns))


def run_experiment(
    spark: SparkSession, members: DataFrame, rows: DataFrame, names: Sequence[str], target: str, base: str | None = None, run_id: str = "study"
) -> dict[str, DataFrame]:
    """Predictions, per-fold results, tests and breakdowns of every family in both scopes.

    ``base`` is a folder that executors share; starting again with the same one goes on where the last run stopped.
    """
    if base is None:
        ensure_checkpoint_dir(spark)
        base = f"{spark.sparkContext.getCheckpointDir()}/study-{uuid.uuid4().hex}"
    store = study.Store(spark, base, run_id)
    study.run(store, study.Data(members, rows, names, target), study.families_for(target))
    return study.tables(store, target)


def persist(spark: SparkSession, base: str, run_id: str, target: str, tables: dict[str, DataFrame]) -> None:
    """Write every table of a run and register it in the append-only index."""
    store.write_run(tables, base, run_id)
    models = [r["model"] for r in tables["predictions"].select("model").distinct().orderBy("model").collect()]
    n = tables["predictions"].agg(F.count(F.lit(1))).first()[0]
    store.append_run_index(spark, base, {"run_id": run_id, "target": target, "models": models, "n_rows": n})
