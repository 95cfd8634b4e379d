"""The study's ledger: a killed run resumes, failed folds are rows, arms and gains reach the tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import linear
from barloom.plans import study

SCHEMA = "fold int, split string, asset string, date date, x array<double>, y double"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    rows = []
    for fold in range(3):
        for asset in ("A", "B"):
            for i in range(640):
                split = "train" if i < 540 else "val" if i < 600 else "test"
                x = rng.normal(size=2)
                rows.append((fold, split, asset, dt.date(2015, 1, 1) + dt.timedelta(days=i + 40 * fold), x.tolist(), float(0.01 * x[0] + rng.normal() * 0.001)))
        rows += [(fold, "train", "S", dt.date(2015, 1, 1), [0.0, 0.0], 0.0), (fold, "test", "S", dt.date(2017, 1, 1), [0.0, 0.0], 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA).cache()
    members = frame.withColumn("ret_lag1", F.get("x", F.lit(1)) / 100).withColumn("ret_1d", F.col("y"))
    return study.Data(members, frame, ["a", "b"], "ret_1d")


def ridge(calls=None, killed=(), failing=()):
    def fit(data):
        folds = sorted(r[0] for r in data.rows.select("fold").distinct().collect())
        if calls is not None:
            calls.append(folds)
        if set(folds) & set(killed):
            raise SystemExit("killed")
        if set(folds) & set(failing):
            raise ValueError(f"cannot fit {folds}")
        return study.linear_family(data)

    return study.Family("ridge", ("ridge", "ridge" + linear.SUFFIX), fit)


def ledger(store):
    return {(r.model, r.fold): r.status for r in store.ledger().collect()}


def test_a_killed_run_resumes_without_fitting_twice(spark, data, tmp_path):
    store = study.Store(spark, str(tmp_path), "r1")
    base = study.families_for("ret_1d")[0]
    with pytest.raises(SystemExit):
        study.run(store, data, [base, ridge(killed=(0, 1, 2))])
    assert set(ledger(store).values()) == {study.DONE} and len(ledger(store)) == 9
    # stopped after the forecasts were written and before the ledger was: they must not count
    family = ridge()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(store, "append", lambda rows: (_ for _ in ()).throw(SystemExit("killed")))
        with pytest.raises(SystemExit):
            study.run(store, data.only([0]), [family])
    assert store.read("forecasts", study.FORECASTS).filter("model = 'ridge'").isEmpty()
    calls = []
    study.run(store, data, [base, ridge(calls)])
    study.run(store, data, [base, ridge(calls)])
    assert calls == [[0, 1, 2]] and len(ledger(store)) == 15
    found = study.tables(store, "ret_1d")
    assert found["predictions"].groupBy("model", "fold", "asset", "date").count().filter("count > 1").isEmpty()
    scope = {r.asset for r in found["scope"].filter("family = 'ridge'").collect()}
    assert scope == {"A", "B", "all"}
    top = found["importance_top"].filter("model = 'ridge'").orderBy("rank").collect()
    assert [r.feature for r in top] == ["a", "b"] and top[0].n_folds == 3
    assert found["importance_rank_stability"].filter("feature = 'a' and worst_rank > 1").isEmpty()
    own = found["predictions"].filter(F.col("model") == "ridge" + linear.SUFFIX)
    assert own.filter("asset = 'S' and pred is null").count() == 3 and own.filter("asset = 'A' and pred is null").isEmpty()


def test_failed_folds_are_rows_and_the_others_go_on(spark, data, tmp_path):
    store = study.Store(spark, str(tmp_path), "r2")
    arma = study.families_for("ret_1d")[-1]
    study.run(store, data.only([0]), [arma])
    assert ledger(store) == {("arima", 0): study.DONE}
    wrong = study.Family("wrong", ("other",), arma.fit)
    study.run(store, data.only([0]), [wrong])
    assert "does not name" in store.ledger().filter("model = 'other'").first()["message"]
    store = study.Store(spark, str(tmp_path), "r3")
    study.run(store, data, [ridge(failing=(1,))])
    assert ledger(store) == {(m, f): study.FAILED if f == 1 else study.DONE for m in ("ridge", "ridge" + linear.SUFFIX) for f in range(3)}
    assert "cannot fit [1]" in store.ledger().filter("fold = 1").first()["message"]
    calls = []
    study.run(store, data, [ridge(calls)])
    assert calls == []
    study.run(store, data, [ridge(calls)], retry_failed=True)
    assert calls == [[1]]
    rows = study.tables(store, "ret_1d")["results"]
    assert rows.filter("model = 'ridge'").count() == 3
