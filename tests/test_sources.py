import hashlib

import pytest
from pyspark.sql import functions as F

from barloom.operators import quality
from barloom.sources import auxiliary, klines, store, trades


def _line(ms, close, trades="5"):
    return f"{ms},1,2,0.5,{close},10,{ms + 1},100,{trades},5,50,0"


def test_kline_files(spark, tmp_path):
    d = tmp_path / "BTCUSD"
    d.mkdir()
    day = 1_600_041_600_000
    head = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"
    (d / "a.csv").write_text("\n".join([head, _line(day, 1.5), _line(day, 1.7, ""), _line(day + 86_400_000, "oops")]) + "\n")
    (d / "b.csv").write_text(_line((day + 2 * 86_400_000) * 1000, 1.9) + "\n")
    bars = klines.tidy_klines(klines.read_klines(spark, str(tmp_path)))
    panel = klines.assemble_panel(bars, {"BTCUSD": "BTC"}, "venue").orderBy("date").collect()
    assert [(str(r["date"]), r["close"], r["trades"]) for r in panel] == [("2020-09-14", 1.7, 0), ("2020-09-16", 1.9, 5)]
    bad = spark.createDataFrame([("5",), ("1600041600000",)], "open_time string")
    assert klines.epoch_problems(bad, "open_time").count() == 1


def test_checksums(spark, tmp_path):
    for name, ok in (("x.csv", True), ("y.csv", False)):
        body = name.encode() * 3
        (tmp_path / name).write_bytes(body)
        digest = hashlib.sha256(body if ok else b"other").hexdigest()
        (tmp_path / f"{name}.CHECKSUM").write_text(f"{digest}  {name}\n")
    (tmp_path / "z.csv").write_text("no checksum")
    got = {r["path"].rsplit("/", 1)[1]: r["ok"] for r in klines.verify_checksums(spark, str(tmp_path)).collect()}
    assert got == {"x.csv": True, "y.csv": False, "z.csv": False}


def test_candles_keep_the_last_of_a_day(spark):
    body = "[[1600128000,1,3,2,2.5,9],[1600041600,1,3,2,2.2,8],[1600041660,1,3,2,2.3,7]]"
    rows = auxiliary.read_candles_json(spark.createDataFrame([(body,)], "body string")).orderBy("date").collect()
    assert [(str(r["date"]), r["close"]) for r in rows] == [("2020-09-14", 2.3), ("2020-09-15", 2.5)]


def test_macro_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("observation_date,VIX\n2020-01-01,.\n2020-01-02,12.5\n")
    (tmp_path / "b.csv").write_text("DATE,RATE\n2020-01-02,\n2020-01-03,1.5\n")
    series = [auxiliary.read_macro_series(spark, str(tmp_path / f), n) for f, n in (("a.csv", "vix"), ("b.csv", "rate"))]
    rows = auxiliary.macro_wide(series, ["vix", "rate"]).orderBy("date").collect()
    assert [(r["vix"], r["rate"]) for r in rows] == [(None, None), (12.5, None), (None, 1.5)]


def test_panel_and_aux_round_trip(spark, golden, tmp_path):
    path = str(tmp_path / "panel")
    store.write_panel(golden, path)
    assert store.load_panel(spark, path).exceptAll(golden).isEmpty()
    with pytest.raises(Exception):
        store.load_panel(spark, str(tmp_path / "absent")).count()
    a = golden.select("date", F.col("close").alias("fng"))
    b = golden.select("date", "asset", F.col("volume").alias("txcnt"))
    store.write_aux({"sentiment": a, "onchain": b}, str(tmp_path / "aux"))
    back = store.read_aux(spark, str(tmp_path / "aux"), "onchain", ["date", "asset", "txcnt"])
    assert back.count() == b.count()
    assert "PartitionFilters: [isnotnull(_source" in back._jdf.queryExecution().executedPlan().toString()


def test_runs(spark, golden, tmp_path):
    base = str(tmp_path)
    for run in ("r1", "r2", "r1"):
        store.write_run({"results": golden.select("asset", "close")}, base, run)
    assert store.load_run(spark, base, "r1", "results").count() == golden.count()
    for run in ("r1", "r2"):
        store.append_run_index(spark, base, {"run_id": run, "target": "ret_1d", "models": ["zero"], "n_rows": 1})
    assert store.latest_run(spark, base).first()["run_id"] == "r2"
    assert store.config_hash({"b": 1, "a": 2}) == store.config_hash({"a": 2, "b": 1})


def test_validation(spark, golden):
    quality.raise_if_failed(quality.validate_panel(golden))
    quality.check_panel_key(golden)
    with pytest.raises(quality.PanelInvalid):
        quality.check_panel_key(golden.unionByName(golden))
    broken = golden.withColumn("low", F.when(F.col("asset") == "ETH", F.col("high") * 2).otherwise(F.col("low")))
    found = {r["check"]: (r["severity"], r["n_bad"]) for r in quality.validate_panel(broken).collect()}
    assert found["ohlc_ordering"] == ("error", 5) and found["ohlc_positive"] == ("info", 0)
    with pytest.raises(quality.PanelInvalid):
        quality.raise_if_failed(quality.validate_panel(broken))
    empty = quality.source_agreement(golden.select("asset", "date", "close"), golden.select("asset", "date", "close").limit(0))[0]
    assert quality.agreement_finding(empty).first()["severity"] == "warning"


def test_ties_of_the_order_key_fall_to_the_rest_of_the_tuple(spark):
    rows = [("a", 1, 2, 5.0), ("a", 1, 1, 7.0), ("a", 2, 9, 3.0), ("a", 3, 1, 4.0), ("a", 3, 2, 6.0)]
    t = spark.createDataFrame(rows, "asset string, o bigint, tie int, p double").repartition(3)
    got = trades.bars(
        t, asset="asset", bucket=F.lit("2020-01-01").cast("date"), price=F.col("p"), order_by=F.col("o"),
        ties=F.col("tie"), volume="p", quote_volume="p", taker_buy=F.col("p"), source="t",
    ).first()
    assert (got["open"], got["close"], got["high"], got["low"], got["trades"]) == (7.0, 6.0, 7.0, 3.0, 5)


def test_ingest_findings_count_what_is_left_out(spark):
    columns = ("symbol", "open_time", "close")
    raw = spark.createDataFrame(
        [("XUSD", "1600000000000", "1"), ("XUSD", "12", "1"), ("XUSD", "x", "1"), ("XUSD", "1600000000000", ""),
         ("YUSD", "1600000000000", "2"), (None, "1600000000000", "2")], "symbol string, open_time string, close string",
    ).select(*columns)
    got = {(r["check"], r["symbol"]): r["n"] for r in klines.ingest_findings(raw, {"XUSD": "X"}).collect()}
    assert got == {
        ("implausible_epoch", "XUSD"): 1, ("unreadable_epoch", "XUSD"): 1, ("unreadable_close", "XUSD"): 1,
        ("unmapped_symbol", "YUSD"): 1, ("unmapped_symbol", None): 1,
    }
    assert klines.ingest_findings(raw.limit(0), {"XUSD": "X"}).isEmpty()
