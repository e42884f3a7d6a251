"""Binary series as a data source: values, defaults, and reads of a part."""

import datetime
import math
import struct

from tidewell.sources import series

D = datetime.date


def folder(tmp_path):
    (tmp_path / "calendars").mkdir()
    (tmp_path / "calendars" / "day.txt").write_text("2020-01-01\n2020-01-02\n2020-01-03\n\n")
    for name, close in (("sh600000", (1, 10, math.nan)), ("sz1", (0, 5, 6, 7))):
        (tmp_path / "features" / name).mkdir(parents=True)
        (tmp_path / "features" / name / "close.day.bin").write_bytes(struct.pack(f"<{len(close)}f", *close))
    (tmp_path / "features" / "sh600000" / "open.day.bin").write_bytes(struct.pack("<2f", 1, 9))
    (tmp_path / "features" / "sh600000" / "return.day.bin").write_bytes(b"")
    return f"file://{tmp_path}"


def keyed(frame):
    return {(r.instrument, r.datetime.day): (r.open, r.high, r.close, r.volume, r.ret, r.vwap) for r in frame.collect()}


def test_rows_and_defaults(spark, tmp_path):
    got = keyed(series.read_series(spark, folder(tmp_path), instruments_per_task=1))
    assert got[("SH600000", 2)] == (9.0, 10.0, 10.0, 0.0, 0.0, 10.0)
    assert sorted(got) == [("SH600000", 2), ("SZ1", 1), ("SZ1", 2), ("SZ1", 3)]


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    root = folder(tmp_path)
    assert sorted(keyed(series.read_series(spark, root, ["sz1"], "2020-01-02", "2020-01-03", 1))) == [("SZ1", 2), ("SZ1", 3)]
    some, every = series.read_series(spark, root, ["SZ1"], instruments_per_task=1), series.read_series(spark, root, instruments_per_task=1)
    assert (some.rdd.getNumPartitions(), every.rdd.getNumPartitions()) == (1, 2)
    assert (some.count(), every.count()) == (3, 4)  # a read of some leaves the next one whole
    assert series.read_series(spark, root, start="2020-01-04").count() == 0
    assert series.read_series(spark, root, []).count() == 0
    assert sorted(keyed(series.read_series(spark, root, None, "2020-01-02", "2020-01-02").where("close > 5.5"))) == [("SH600000", 2), ("SZ1", 2)]


def test_round_trip_with_gaps(spark, tmp_path):
    rows = [(D(2020, 1, 1), "A", 1.5), (D(2020, 1, 3), "A", 2.5), (D(2020, 1, 2), "B", None), (D(2020, 1, 3), "B", 4.0), (None, "B", 1.0), (D(2020, 1, 1), None, 1.0)]
    panel = spark.createDataFrame(rows, "datetime date, instrument string, close double")
    root = f"file://{tmp_path}/out"
    assert series.write_series(panel, root, ["close"]) == 2
    assert {k: v[2] for k, v in keyed(series.read_series(spark, root)).items()} == {("A", 1): 1.5, ("A", 3): 2.5, ("B", 3): 4.0}


def test_no_instruments(spark, tmp_path):
    (tmp_path / "calendars").mkdir()
    (tmp_path / "calendars" / "day.txt").write_text("")
    assert series.read_series(spark, f"file://{tmp_path}").count() == 0
