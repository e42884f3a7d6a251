import datetime

import numpy as np
import pandas as pd
import pytest

from tidewell.operators import comoments as cm
from tidewell.operators import panel as pn


@pytest.mark.parametrize("part_rows", [1 << 21, 500])
def test_158_factors_against_pandas(spark, part_rows):
    rng = np.random.default_rng(5)
    k, names, days = 158, [f"i{j:02d}" for j in range(25)], [datetime.date(2024, 1, 1 + d) for d in range(3)]
    frames = []
    for d in days:
        x = rng.normal(size=(len(names), k)) * 10.0 ** rng.integers(-3, 6, k) + 1e4 * rng.integers(0, 2, k)
        x[rng.random(x.shape) < 0.2] = np.nan
        x[:, 3] = 0.1  # varies nowhere
        x[:, 4] = np.where(np.isnan(x[:, 5]), x[:, 4], 0.3)  # nor where another has values
        frames.append(pd.DataFrame(x, columns=[f"f{j:03d}" for j in range(k)]).assign(datetime=d, instrument=names))
    long = pd.concat(frames).melt(["datetime", "instrument"], var_name="factor").sample(frac=1, random_state=1)
    got = cm.factor_correlations(spark.createDataFrame(long.dropna()), part_rows).toPandas().set_index(["f", "g"])
    daily = np.array([f.drop(columns=["datetime", "instrument"]).corr().to_numpy() for f in frames])
    assert len(got) == k * (k - 1) // 2
    for a in (0, 3, 4, 5, 77, 156):
        for b in range(a + 1, k):
            r = daily[:, a, b]
            if a == 4 and b == 5 or a == 3 or b == 3:
                assert np.isnan(got.loc[(f"f{a:03d}", f"f{b:03d}"), "mean_corr"])
                continue
            row = got.loc[(f"f{a:03d}", f"f{b:03d}")]
            assert row.mean_corr == pytest.approx(r.mean(), abs=1e-9) and row.mean_abs_corr == pytest.approx(np.abs(r).mean(), abs=1e-9) and row.max_abs_corr == pytest.approx(np.abs(r).max(), abs=1e-9)


def test_moments_add_up_in_any_parts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 7)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    whole = cm.CoMoments.of(x)
    parts = cm.CoMoments.none(7)
    for low, high in ((0, 1), (1, 30), (30, 30), (30, 60)):
        parts += cm.CoMoments.of(x[low:high])
    for a, b in ((whole.n, parts.n), (whole.mean, parts.mean), (whole.square, parts.square), (whole.cross, parts.cross)):
        assert np.allclose(a, b, rtol=1e-9)


def test_no_values(spark):
    assert cm.factor_correlations(spark.createDataFrame([], "datetime date, instrument string, factor string, value double")).count() == 0


@pytest.mark.parametrize("days", [1, 7, 250])
def test_event_sweep_against_a_range_join(spark, days):
    rng = np.random.default_rng(days)
    start = datetime.date(2023, 1, 1)
    panel = [(start + datetime.timedelta(int(d)), f"i{rng.integers(4)}", int(n)) for n, d in enumerate(rng.integers(0, 400, 150))]
    panel = list({(r[0], r[1]): r for r in panel}.values())
    events = []
    for _ in range(200):
        h = start + datetime.timedelta(int(rng.integers(-300, 400)))
        late = None if rng.random() < 0.05 else h + datetime.timedelta(int(rng.choice([0, 0, 1, 5, 100])))
        events.append((f"i{rng.integers(5)}", None if rng.random() < 0.05 else h, late, None if rng.random() < 0.1 else float(rng.choice([0.1, 1e9, 7.25]))))
    p = spark.createDataFrame(panel, "datetime date, instrument string, n int")
    e = spark.createDataFrame(events, "instrument string, h date, vis date, amount double")
    got = {r.n: (r[f"count_{days}d"], r[f"amount_{days}d"], r.recency) for r in pn.event_window(p, e, days, "h", "vis", "amount").collect()}
    assert len(got) == len(panel)
    for d, i, n in panel:
        mine = [(h, a) for j, h, v, a in events if j == i and h and v and h <= d and v <= d and (d - h).days < days]
        assert got[n] == (len(mine), pytest.approx(sum(a or 0 for _, a in mine)), min(((d - h).days for h, _ in mine), default=None))
