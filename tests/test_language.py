"""Cells of a small panel: four days, two instruments, prices d + offset."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import columns as c


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(datetime.date(2020, 1, d), i, *[float(d + o)] * 5, 100.0, 0.0) for d in range(1, 5) for i, o in (("A", 0), ("B", 1))]
    return spark.createDataFrame(rows, "datetime date, instrument string, open double, high double, low double, close double, vwap double, volume double, ret double").cache()


CELLS = {
    "ts_mean": (lambda: c.ts_mean("close", 2), 1.5),
    "growth": (lambda: c.ts_pctchange("close"), 1.0),
    "ts_rank": (lambda: c.ts_rank("close", 2), 1.0),
    "quantile": (lambda: c.ts_quantile("close", 2, 0.5), 1.5),
    "argmax": (lambda: c.ts_argmax("high", 2), 2.0),
    "argmin": (lambda: c.ts_argmin("low", 2), 1.0),
    "slope": (lambda: c.ts_slope("close", 2), 1.0),
    "rsquare": (lambda: c.ts_rsquare("close", 2), 1.0),
    "resi": (lambda: c.ts_resi("close", 2), 0.0),
    "greater": (lambda: c.greater(c.delta("close"), 0.0), 1.0),
    "mean_of_flags": (lambda: c.ts_mean(c.gt("close", c.delay("close")), 2), 0.5),
    "zscore": (lambda: c.ts_zscore("close", 2), 0.7071067811865475),
    "rank": (lambda: c.cs_rank("close"), 0.5),
    "median": (lambda: c.cs_median("close"), 2.5),
    "max": (lambda: c.greater(0.0, F.col("close") - 2), 0.0),
    "var": (lambda: c.ts_var("close", 2), 0.5),
    "inv": (lambda: c.inv("close"), 0.5),
    "sign": (lambda: c.sign(F.col("close") - 2), 0.0),
    "filter": (lambda: c.masked("close", c.gt("volume", 0)), 2.0),
    "bb_upper": (lambda: c.bb_upper("close", 2), 1.5 + math.sqrt(0.5)),
    "sumif": (lambda: c.sumif("ret", 2, c.gt("volume", 0)), 0.0),
    "where": (lambda: c.where(c.gt("close", c.cs_median("close")), c.where(c.gt("volume", 0), 1.0, -1.0), 0.0), 0.0),
    "regbeta_constant": (lambda: c.regbeta_constant("close", math.log(5), 1), 2 * math.log(5) / (math.log(5) ** 2 + 1)),
}


def test_cells(panel):
    row = panel.select("datetime", "instrument", *(f().alias(k) for k, (f, _) in CELLS.items())).where("instrument = 'A' and datetime = date '2020-01-02'").first()
    for k, (_, expected) in CELLS.items():
        assert row[k] == pytest.approx(expected, rel=1e-9, abs=1e-12), k


def test_nulls_and_nan(spark):
    d = [datetime.date(2020, 1, i) for i in (1, 2, 3)]
    rows = [(d[0], "A", None), (d[0], "B", 2.0), (d[1], "A", 3.0), (d[1], "B", 3.0), (d[2], "A", 4.0), (d[2], "B", float("nan"))]
    p = spark.createDataFrame(rows, "datetime date, instrument string, x double").withColumn("x", c.finite("x"))
    out = {(r.datetime.day, r.instrument): r for r in p.select("datetime", "instrument", c.fill_null("x", 0).alias("f"), c.cs_fill_null("x").alias("cf"), c.cs_zscore("x").alias("z"), c.ts_zscore("x", 2).alias("tz"), c.cs_rank("x").alias("r")).collect()}
    assert out[1, "A"].f == 0.0 and out[1, "A"].cf == 2.0 and out[1, "A"].r is None
    assert out[2, "A"].z == 0.0 and out[2, "A"].tz == 0.0
    assert out[3, "B"].f == 0.0 and out[3, "B"].z is None and out[3, "A"].r == 1.0


def test_language_shares_shuffles(panel):
    plan = panel.select(c.ts_mean("close", 2), c.ts_std("close", 3), c.ts_rank("close", 4), c.cs_rank("close"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_nan_counts_as_null_in_a_cross_section(spark):
    from pyspark.sql import functions as F

    rows = [("d", i, v, r) for i, v, r in (("a", float("nan"), float("nan")), ("b", 10.0, 10.0), ("c", 20.0, 30.0), ("d", 30.0, 20.0))]
    p = spark.createDataFrame(rows, "datetime string, instrument string, pe double, x double")
    out = p.select("instrument", c.cs_zscore("pe").alias("z"), c.cs_mean("pe").alias("mean"), c.cs_std("pe").alias("std"), c.cs_median("pe").alias("median"), c.cs_rank("x").alias("rank"), c.cs_max("pe").alias("top"), c.divide("pe", F.lit(1e-320)).alias("far"))
    got = {r.instrument: r for r in out.collect()}
    assert [got[i].z for i in "abcd"] == [None, -1.0, 0.0, 1.0]
    assert {r.mean for r in got.values()} == {20.0} and {r["std"] for r in got.values()} == {10.0} and {r["median"] for r in got.values()} == {20.0} and {r.top for r in got.values()} == {30.0}
    assert [got[i]["rank"] for i in "abcd"] == [None, 1 / 3, 1.0, 2 / 3]
    assert all(r.far is None for r in got.values())
    wild = spark.createDataFrame([("d", "a", float("inf")), ("d", "b", 1.0), ("d", "c", 3.0)], "datetime string, instrument string, v double")
    assert {r.m for r in wild.select(c.cs_mean("v").alias("m")).collect()} == {2.0}
