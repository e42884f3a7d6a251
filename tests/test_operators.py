import datetime

from tidewell import streaming
from tidewell.operators import panel as pn
from tidewell.sources import parse_date, predicate

D = datetime.date


def test_as_of_has_no_look_ahead(spark):
    left = spark.createDataFrame([("a", D(2020, 1, i)) for i in (1, 2, 3)], "k string, d date")
    right = spark.createDataFrame([("a", D(2020, 1, 2), 5.0), ("a", D(2020, 1, 2), 7.0), ("b", D(2020, 1, 1), 1.0)], "k string, seen date, v double")
    got = {r.d.day: r.v for r in pn.as_of(left, right, "k", "d", "seen", ["v"]).collect()}
    assert got == {1: None, 2: 7.0, 3: 7.0}
    strict = {r.d.day: r.v for r in pn.as_of(left, right, "k", "d", "seen", ["v"], strict=True).collect()}
    assert strict == {1: None, 2: None, 3: 7.0}


def test_fill_row(spark):
    rows = [(D(2020, 1, 1), "a", *[10.0] * 4, 5.0, 10.0), (D(2020, 1, 2), "b", *[20.0] * 4, 5.0, 20.0)]
    p = spark.createDataFrame(rows, "datetime date, instrument string, open double, high double, low double, close double, volume double, vwap double")
    r = next(r for r in pn.filled(pn.completed(p)).collect() if r.instrument == "a" and r.datetime.day == 2)
    assert (r.open, r.high, r.low, r.close, r.vwap, r.volume, r.ret) == (10.0, 10.0, 10.0, 10.0, 10.0, 0.0, 0.0)
    assert r.close_was_missing and r.is_suspended


def test_event_window_counts_visible_events(spark):
    p = spark.createDataFrame([(D(2020, 1, i), "a") for i in (1, 2, 9)], "datetime date, instrument string")
    e = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 1, 1), 2.0), ("a", D(2020, 1, 1), D(2020, 1, 2), 3.0)], "instrument string, h date, v date, x double")
    got = {r.datetime.day: (r.count_7d, r.amount_7d, r.recency) for r in pn.event_window(p, e, 7, "h", "v", "x").collect()}
    assert got == {1: (1, 2.0, 0), 2: (2, 5.0, 1), 9: (0, 0.0, None)}


def test_dates_and_predicates(spark):
    x = spark.createDataFrame([("20200105",), ("2020-01-05",), ("202001",), ("junk",)], "s string")
    assert [r.d for r in x.select(parse_date(x.s).alias("d")).collect()] == [D(2020, 1, 5), D(2020, 1, 5), D(2020, 1, 1), None]
    n = spark.range(5)
    assert n.where(predicate("id", "between", (1, 3))).where(predicate("id", "!=", 2)).count() == 2


def test_streamed_panel_equals_batch(spark, tmp_path):
    t = datetime.datetime
    rows = [(7, 1, t(2020, 1, 1, 9), 3.0), (9, 1, t(2020, 1, 1, 11), 5.0), (8, 1, t(2020, 1, 1, 11), 4.0), (1, 2, t(2020, 1, 2, 9), 1.0), (2, 1, t(2020, 1, 9), 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = streaming.daily_panel(streaming.arriving(spark, str(tmp_path / "in"), "event_id long, user_id long, ts timestamp, value double"))
    q = stream.writeStream.format("memory").queryName("panel_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.instrument, r.datetime.day): (r.open, r.close, r.volume) for r in spark.table("panel_out").collect()}
    assert got == {("1", 1): (3.0, 5.0, 3.0), ("2", 2): (1.0, 1.0, 1.0), ("1", 9): (1.0, 1.0, 1.0)}
