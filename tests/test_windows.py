"""Statistics of full windows in one pass, against the column functions."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import columns as c
from tidewell.operators.windows import Windows
from tidewell.plans import factors as fs

START = datetime.date(2020, 1, 1)
NAMES = ("open", "close", "high", "low", "volume", "vwap")


def panel(spark, sizes, nulls=0.02, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i, size in enumerate(sizes):
        for d in range(size):
            v = [float(x) if rng.random() >= nulls else None for x in np.where(rng.random(6) < 0.5, rng.integers(1, 6, 6), rng.gamma(2, 10, 6))]
            if i == 2:  # hardly varies
                v = [0.1, 0.1 + 1e-6 * (d % 2), 0.1, 0.1, 3.0, 0.1]
            if i == 3 and d % 17 in (4, 9):
                v[1:5] = [math.nan, math.inf, math.nan, -math.inf][:: 1 if d % 2 else -1]
            rows.append((START + datetime.timedelta(d), f"i{i}" if i else None, *v))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "datetime date, instrument string, " + ", ".join(f"{n} double" for n in NAMES))


def same(got, want):
    keys = ["instrument", "datetime"]
    got, want = (f.select(*keys, *(F.col(n).cast("double").alias(n) for n in want.columns if n not in keys)) for f in (got, want))
    a, b = ({tuple(r[:2]): r[2:] for r in f.collect()} for f in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        for name, x, y in zip(want.columns[2:], a[k], b[k], strict=True):
            assert x == y or x is not None and y is not None and math.isnan(x) and math.isnan(y), (k, name, x, y)


@pytest.mark.parametrize("batch_rows", [7, 10_000])
def test_same_digits_as_the_column_functions(spark, batch_rows):
    p = panel(spark, (150, 70, 40, 90, 3, 1))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        one = ("ts_mean", "ts_sum", "ts_std", "ts_min", "ts_max", "ts_argmin", "ts_argmax", "ts_rank", "ts_slope", "ts_rsquare", "ts_resi")

        def asked(w):
            step = F.col("close") - w.delay("close", 2)
            out = {f"{f}_{n}": getattr(w, f)("close", n) for f in one for n in (1, 2, 5, 60)} | {f"step_{f}": getattr(w, f)(step, 5) for f in one}
            out |= {f"q_{n}_{int(q * 10)}": w.ts_quantile("close", n, q) for n in (1, 5, 60) for q in (0.2, 0.5, 0.8)} | {f"low_{f}": getattr(w, f)("low", 20) for f in one}
            return out | {f"corr_{n}": w.ts_corr("close", "volume", n) for n in (1, 5, 60)} | {"corr_step": w.ts_corr("high", step, 5), "change": w.ts_pctchange("open", 3)}

        w = Windows()
        own = asked(w)
        same(w.over(p).select("datetime", "instrument", *(v.alias(k) for k, v in own.items())), p.select("datetime", "instrument", *(v.alias(k) for k, v in asked(c).items())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_windows_not_gone_over_for_each_expression(spark):
    w = Windows()
    factors = fs.alpha_158(w)
    assert len(factors) == 158
    p = panel(spark, (4, 4))
    plan = fs.with_factors(w.over(p), factors)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "percentile" not in plan and "collect_list" not in plan and "regr" not in plan


def test_empty(spark):
    w = Windows()
    mean = w.ts_mean("close", 3)
    assert w.over(panel(spark, ())).select(mean).count() == 0
