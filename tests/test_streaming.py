"""Streams over small folders, run to their end."""

import datetime

from tidewell import streaming
from tidewell.operators.store import EventLog

T = datetime.datetime


def stream(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return streaming.arriving(spark, path, schema)


def rows_of(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name).collect()


def test_changes_count_once_and_are_routed(spark, tmp_path):
    rows = [("daily", "new", T(2020, 1, 1, h)) for h in (1, 2)] + [("daily", "modified", T(2020, 1, 1, 3)), ("other", "new", T(2020, 1, 1, 4))]
    got = rows_of(spark, streaming.routed(stream(spark, tmp_path, "c", rows, "dataset string, change_type string, ts timestamp"), {"daily": ["update", "ops"]}), "routed")
    assert sorted((r.dataset, r.change_type, r.workflows) for r in got) == [("daily", "modified", ["update", "ops"]), ("daily", "new", ["update", "ops"]), ("other", "new", [])]


def test_sessions(spark, tmp_path):
    rows = [(1, T(2020, 1, 1, 9, 0), 1.0), (1, T(2020, 1, 1, 9, 20), 2.0), (1, T(2020, 1, 1, 12), 4.0)]
    got = rows_of(spark, streaming.sessions(stream(spark, tmp_path, "s", rows, "user_id long, ts timestamp, value double")), "sessions_out", "complete")
    assert sorted((r.n, r.total) for r in got) == [(1, 4.0), (2, 3.0)]


def test_breaker_opens_and_recovers(spark, tmp_path):
    seconds = [(0, False), (1, False), (2, False), (3, True), (400, True), (401, True)]
    rows = [("a", T(2020, 1, 1) + datetime.timedelta(seconds=s), ok) for s, ok in seconds] + [("b", T(2020, 1, 1), True)]
    got = rows_of(spark, streaming.breaker(stream(spark, tmp_path, "b", rows, "service string, ts timestamp, ok boolean")), "breaker_out")
    a = [(r.state, r.let_through) for r in sorted(got, key=lambda r: r.ts) if r.service == "a"]
    assert a == [("closed", True), ("closed", True), ("closed", True), ("open", False), ("half_open", True), ("closed", True)]


def test_cycle_pool_and_logs(spark, tmp_path):
    seen = []
    rows = [(1, 0.5), (2, 0.9), (3, 0.7)]
    streaming.cycle(stream(spark, tmp_path, "t", rows, "id long, metric double"), {"count": lambda b: seen.append(b.count()), "max": lambda b: seen.append(b.agg({"metric": "max"}).first()[0])}, str(tmp_path / "k1")).awaitTermination(180)
    assert seen == [3, 0.9]
    path = f"file://{tmp_path}/pool"
    for more in ([], [(4, 0.8), (1, 1.0)]):
        source = stream(spark, tmp_path, "t", more, "id long, metric double") if more else streaming.arriving(spark, str(tmp_path / "t"), "id long, metric double")
        streaming.keep_best(source, path, str(tmp_path / "k2"), 2).awaitTermination(180)
    assert {(r.id, r.metric) for r in streaming.pool_of(spark, path).collect()} == {(1, 1.0), (2, 0.9)}
    streaming.append_log(streaming.arriving(spark, str(tmp_path / "t"), "id long, metric double"), str(tmp_path / "log"), str(tmp_path / "k3")).awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5
    log = EventLog(spark, f"file://{tmp_path}/events", "expression_hash string, sequence long, op string")
    changes = stream(spark, tmp_path, "e", [("x", 1, "upsert"), ("y", 2, "upsert"), ("x", 3, "delete")], "expression_hash string, sequence long, op string")
    streaming.upsert_log(changes, log, str(tmp_path / "k4"), 1).awaitTermination(180)
    assert [r.expression_hash for r in log.effective().collect()] == ["y"]


def test_events_join_when_they_are_visible(spark, tmp_path):
    panel = stream(spark, tmp_path, "p", [("a", T(2020, 1, d)) for d in (2, 5, 20)], "instrument string, ts timestamp")
    events = stream(spark, tmp_path, "v", [("a", T(2020, 1, 1), T(2020, 1, 4)), ("b", T(2020, 1, 1), T(2020, 1, 1))], "instrument string, happened timestamp, visible timestamp")
    got = rows_of(spark, streaming.visible_events(panel, events, 7), "visible_out")
    assert [(r.instrument, r.ts.day, r.visible.day) for r in got] == [("a", 5, 4)]
