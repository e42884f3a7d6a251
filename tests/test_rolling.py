import datetime

import numpy as np
import pandas as pd
import pytest

from tidewell.operators import rolling as ro

START = datetime.date(2020, 1, 1)


def frame(seed, sizes, nulls=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for i, size in enumerate(sizes):
        x = np.where(rng.random(size) < 0.5, rng.integers(0, 6, size), rng.normal(size=size) * 10)
        x[rng.random(size) < nulls] = np.nan
        rows.append(pd.DataFrame({"instrument": f"i{i}" if i else None, "datetime": [START + datetime.timedelta(d) for d in range(size)], "x": x, "len": rng.integers(-1, 40, size)}))
    return pd.concat(rows).sample(frac=1, random_state=seed)


def statistics(n):
    spans = (5, 60, 500)
    return {
        "median": ro.quantile("x", n, 0.5), "q80": ro.quantile("x", n, 0.8), "mad": ro.mad("x", n), "rank": ro.rank("x", n), "argmax": ro.argmax("x", n),
        "argmin": ro.argmin("x", n), "highday": ro.highday("x", n), "lowday": ro.lowday("x", n), **{f"ema{s}": ro.exponential("x", 2 / (s + 1)) for s in spans}, "own": ro.exponential("x", 1.0),
    }


def by_hand(x, n):
    out = []
    for t in range(len(x)):
        w = x[max(0, t - n + 1) : t + 1]
        v = w[~np.isnan(w)]
        full = len(v) == n
        nan = np.nan
        out.append({
            "median": np.median(v) if full else nan, "q80": np.quantile(v, 0.8) if full else nan, "mad": np.median(np.abs(v - np.median(v))) if len(v) else nan,
            "rank": ((v < x[t]).sum() + ((v == x[t]).sum() + 1) / 2) / n if full else nan, "argmax": v.argmax() + 1 if full else nan, "argmin": v.argmin() + 1 if full else nan,
            "highday": len(v) - v.argmax() if len(v) else nan, "lowday": len(v) - v.argmin() if len(v) else nan,
        })
    out = pd.DataFrame(out)
    for s in (5, 60, 500):
        out[f"ema{s}"] = pd.Series(x).ewm(span=s, ignore_na=False).mean().to_numpy()
    return out.assign(own=x)


@pytest.mark.parametrize(("n", "block_rows"), [(5, 4096), (5, 7), (120, 150), (1, 3)])
def test_against_plain_windows(spark, n, block_rows):
    sizes = [40, 700, 1, 333]  # one instrument over many blocks and tasks
    data = frame(n, sizes)
    got = ro.rolled(spark.createDataFrame(data), statistics(n), block_rows).toPandas()
    assert len(got) == len(data)
    for i, size in enumerate(sizes):
        mine = got[got.instrument.isna() if i == 0 else got.instrument == f"i{i}"].sort_values("datetime")
        assert len(mine) == size
        want = by_hand(mine.x.to_numpy(), n)
        for name in want:
            if name == "own":
                continue
            assert np.allclose(mine[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), name
        there = mine.x.notna()
        assert np.allclose(mine.own[there], mine.x[there]) and mine.own[~there].isna().all()


def test_recurrence_over_many_stretches():
    x = np.random.default_rng(1).normal(size=5000)
    for decay in (0.0, 1e-9, 0.3, 0.9, 0.9999):
        y, want = 0.0, []
        for v in x:
            y = decay * y + v
            want.append(y)
        assert np.allclose(ro.recurrence(x, decay), want, rtol=1e-9, atol=1e-12)


def test_bands_with_a_window_per_row(spark):
    data = frame(9, [30, 500])
    got = ro.dynamic_bands(spark.createDataFrame(data), "x", "len").toPandas()
    assert len(got) == len(data)
    for i in range(2):
        mine = got[got.instrument.isna() if i == 0 else got.instrument == f"i{i}"].sort_values("datetime")
        for t, r in enumerate(mine.itertuples()):
            v = mine.x.to_numpy()[: t + 1]
            v = v[~np.isnan(v)]
            v = v[max(0, len(v) - r.len) :] if r.len >= 1 else v[:0]
            want = [np.nan] * 3 if not len(v) else [v.mean() - (d := v.std(ddof=1) if len(v) > 1 else np.nan), v.mean(), v.mean() + d]
            assert np.allclose([r.lower, r.middle, r.upper], want, equal_nan=True)


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], "instrument string, datetime date, x double, len int")
    assert ro.rolled(empty, statistics(5)).count() == ro.dynamic_bands(empty, "x", "len").count() == 0
    with pytest.raises(ValueError):
        ro.rolled(empty, {"a": ro.rank("x", 0)})
