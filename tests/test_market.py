"""Files, refusals and written frames that no query shows."""

import datetime
import math
import struct

import pytest
from pyspark.sql import functions as F

from tidewell.operators import evaluation as ev
from tidewell.operators import panel as pn
from tidewell.operators import similarity as sm
from tidewell.operators.store import EventLog
from tidewell.sources import market
from tidewell.storage import read_manifest

D = datetime.date


def test_binary_series(spark, tmp_path):
    (tmp_path / "calendars").mkdir()
    (tmp_path / "calendars" / "day.txt").write_text("2020-01-01\n2020-01-02\n2020-01-03\n\n")
    folder = tmp_path / "features" / "sh600000"
    folder.mkdir(parents=True)
    (folder / "close.day.bin").write_bytes(struct.pack("<4f", 1, 10, math.nan, 12))
    (folder / "open.day.bin").write_bytes(struct.pack("<2f", 1, 9))
    (folder / "return.day.bin").write_bytes(b"")
    got = market.binary_market(spark, f"file://{tmp_path}").collect()
    assert [(r.datetime, r.instrument, r.open, r.high, r.close, r.volume, r.ret, r.vwap) for r in got] == [(D(2020, 1, 2), "SH600000", 9.0, 10.0, 10.0, 0.0, 0.0, 10.0)]
    assert market.binary_market(spark, f"file://{tmp_path}", start="2020-01-03").count() == 0
    assert market.binary_market(spark, f"file://{tmp_path}", instruments=["sz1"]).count() == 0


def test_csv_market_end_to_end(spark, tmp_path):
    rows = ["trade_date,ts_code,open,high,low,close,vol,amount,pct_chg"]
    for day in range(3):
        for i in range(2):
            close, volume = 20 + 0.07 * day + 0.13 * i, 1000 + 10 * i + day
            rows.append(f"202001{day + 1:02d},S00{i},{close * (0.99 + 0.0001 * i)},{close * 1.02},{close * 0.98},{close},{volume},{close * volume},{0.2 + 0.02 * i}")
    (tmp_path / "m.csv").write_text("\n".join(rows))
    raw = market.read_file(spark, f"file://{tmp_path}/m.csv", "trade_date string, ts_code string, open double, high double, low double, close double, vol double, amount double, pct_chg double")
    got = market.market_frame(raw, instruments=["S001"]).orderBy("datetime").collect()
    assert len(got) == 3 and all(abs(r.vwap - r.close) < 1e-9 and abs(r.ret - 0.0022) < 1e-12 for r in got)
    with pytest.raises(ValueError):
        market.market_frame(raw.drop("close"))
    with pytest.raises(ValueError):
        market.read_file(spark, f"file://{tmp_path}/m.csv")


def test_refusals(spark):
    f = spark.createDataFrame([(D(2020, 1, d), "a", float("nan") if d == 1 else 1.0) for d in (1, 2)], "datetime date, instrument string, x double")
    assert [r.x for r in market.factor_frame(f, ["x"]).orderBy("datetime").collect()] == [None, 1.0]
    with pytest.raises(ValueError):
        market.factor_frame(f.unionByName(f), ["x"])
    with pytest.raises(ValueError):
        market.joined_features([f, f])
    for bad in ({"a": ("2020-01-02", "2020-01-01")}, {"a": ("2020-01-01", "2020-01-02"), "b": ("2020-01-02", "2020-01-03")}, {"a": ("2021-01-01", "2021-01-02")}):
        with pytest.raises(ValueError):
            market.segments(f, bad)
    dates = spark.createDataFrame([(D(2020, 1, 3),)], "datetime date")
    with pytest.raises(ValueError):
        pn.require_coverage(f, dates)
    pn.require_coverage(f, f.select("datetime"))
    with pytest.raises(ValueError):
        pn.daily_batch(f, f.where("datetime = '2020-01-01'").withColumnRenamed("x", "y"), ["y"], "required")
    with pytest.raises(ValueError):
        market.adjusted(f, "qfq")


def test_results_and_frames_are_whole_or_absent(spark, tmp_path):
    r = spark.createDataFrame([(D(2020, 1, 1), 0.02, 0.01, 0.001), (D(2020, 1, 2), -0.01, 0.0, 0.0)], "date date, return double, bench double, cost double")
    root = f"file://{tmp_path}/results"
    market.save_results(r, r.select("date"), {"ic": math.nan, "ir": 1.5}, root)
    assert read_manifest(spark, f"{root}/metrics")["metrics"] == {"ic": 0.0, "ir": 1.5}
    assert [round(x.cumulative_excess_return, 9) for x in spark.read.parquet(f"{root}/cumulative_excess").orderBy("date").collect()] == [0.009, -0.001]
    with pytest.raises(FileNotFoundError):
        market.load_frame(spark, f"file://{tmp_path}/nothing")


def test_log_checks_its_schema_and_keeps_the_archive(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log", "expression_hash string, sequence long, op string, evaluation_status string")
    rows = spark.createDataFrame([("x", 1, "upsert", "a"), ("y", 2, "upsert", "a")], log.schema)
    assert log.effective().count() == 0
    log.append(rows)
    with pytest.raises(ValueError):
        log.append(rows.drop("op"))
    assert log.compact() == []
    log.delete(rows.where("expression_hash = 'x'"))
    log.set_status(rows.where("expression_hash = 'y'"), "retired")
    assert [(r.expression_hash, r.evaluation_status, r.sequence) for r in log.effective().collect()] == [("y", "retired", 4)]
    assert len(log.compact()) == 1  # the first delta, which only the snapshot before last needs


def test_decay_half_life_and_tiers(spark):
    p = spark.createDataFrame([("f", h, v) for h, v in ((1, 0.08), (2, 0.06), (5, 0.03), (10, 0.02))] + [("g", 1, 0.01), ("g", 5, 0.05)], "factor string, horizon int, ic double")
    got = {r.factor: (r.optimal_horizon, round(r.half_life_days, 9), r.decay_speed) for r in ev.decay(p).collect()}
    assert got == {"f": (1, 4.0, "medium"), "g": (5, 0.5, "fast")}


def test_expression_parts(spark):
    e = spark.createDataFrame([(1, "(A/B) * C / (D*E)"), (2, "RANK(x)"), (3, ""), (4, None)], "id int, expression string")
    got = {}
    for r in sm.ablations(e).orderBy("id", "ablation_no").collect():
        got.setdefault(r.id, []).append(r.ablation)
    assert got == {1: ["(A/B)", "C", "(A/B) * C", "(A/B) * C / (D*E)"], 2: ["RANK(x)"]}
    s = spark.createDataFrame([("TS_MEAN($close, 5)", "ts_mean( $close,10)"), ("A", "a "), ("", "x")], "a string, b string")
    assert [r.s for r in s.select(sm.expression_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.9, 1.0, 0.0]
