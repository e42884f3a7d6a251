"""Holdings by windows against a plain walk over the days, and the other portfolio functions."""

import datetime
import random

import pytest

from tidewell.operators import portfolio as pf

D = datetime.date
SCHEMA = "portfolio string, datetime date, instrument string, score double, open double, close double, allowed boolean"


def market(seed, days=30, names="abcdefghij"):
    rng = random.Random(seed)
    rows = []
    for k in range(days):
        for n in names:
            if rng.random() < 0.9:
                price = [rng.choice([None, 0.0, float("nan")]) if rng.random() < 0.15 else 10 + rng.random() * 5 for _ in range(2)]
                score = rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.1 else round(rng.random(), 1)
                rows.append((f"p{seed}", D(2020, 1, 1) + datetime.timedelta(k), n, score, *price, rng.choice([True, True, True, False, None])))
    return rows


def usable(x):
    return x is not None and x == x and 0 < x < float("inf")


def by_hand(rows, topk, n_drop, masked):
    """{(date, instrument): (held, weight, return)} and the reasons, day after day."""
    wish, held, closes, out, reasons = {}, {}, {}, {}, []
    for day in sorted({r[1] for r in rows}):
        today = [r for r in rows if r[1] == day]
        returns = {}
        for _, _, i, _, opened, closed, _ in today:
            was, want = held.get(i, False), wish.get(i, False)
            if usable(opened):
                held[i] = want
            elif was != want:
                reasons.append((day, i, "skip_buy" if want else "skip_sell_keep_position"))
            if held.get(i, False) and not usable(closed):
                reasons.append((day, i, "carry_forward_last_close"))
            new = closed if usable(closed) else closes.get(i)
            returns[i] = new / closes[i] - 1 if closes.get(i) and new else 0.0
            closes[i] = new
        n = sum(held.get(r[2], False) for r in today)
        for r in today:
            h = held.get(r[2], False)
            out[day, r[2]] = (h, 0.95 / n if h else 0.0, returns[r[2]])
        able = [r for r in today if r[3] is not None and r[3] == r[3] and abs(r[3]) < float("inf") and (r[6] or not masked)]
        rank = {r[2]: k + 1 for k, r in enumerate(sorted(able, key=lambda r: (-r[3], r[2])))}
        for r in today:
            k = rank.get(r[2])
            wish[r[2]] = False if k is None or k > topk + n_drop else True if k <= topk else wish.get(r[2], False)
    return out, sorted(reasons)


@pytest.mark.parametrize("masked", [False, True])
def test_holdings_against_a_walk_over_days(spark, masked):
    rows = market(1) + market(2)
    frame = spark.createDataFrame(rows, SCHEMA)
    held = pf.holdings(frame if masked else frame.drop("allowed"), topk=3, n_drop=2).cache()
    counts, examples = pf.missing_prices(held, 10_000)
    for p in ("p1", "p2"):
        want, reasons = by_hand([r for r in rows if r[0] == p], 3, 2, masked)
        got = {(r.datetime, r.instrument): (r.held, r.weight, r.day_return) for r in held.where(f"portfolio = '{p}'").collect()}
        assert got.keys() == want.keys()
        for key, (h, weight, change) in want.items():
            assert got[key] == (h, pytest.approx(weight), pytest.approx(change))
        assert sorted((r.date, r.instrument, r.reason) for r in examples.where(f"portfolio = '{p}'").collect()) == reasons
        assert {r.reason: r.n for r in counts.where(f"portfolio = '{p}'").collect()} == {k: sum(x[2] == k for x in reasons) for k in {x[2] for x in reasons}}
    days = pf.reports(held, capital=100.0, open_cost=0.01, close_cost=0.02).where("portfolio = 'p1'").orderBy("date").collect()
    equity = 100.0
    for r in days:
        equity *= 1 + r["return"] - r.cost
        assert r.equity == pytest.approx(equity) and r.excess_return == pytest.approx(r["return"] - r.cost)


def test_empty_market(spark):
    held = pf.holdings(spark.createDataFrame([], SCHEMA))
    assert held.count() == pf.reports(held).count() == pf.missing_prices(held)[1].count() == 0


def test_periods_are_refused():
    good = {"name": "a", "train": ("2020", "2021"), "valid": ("2021", "2022"), "test": ("2022", "2023")}
    assert pf.period_runs([good])[0]["name"] == "a"
    for bad in ({"name": " "}, {"train": ("2021", "2020")}, {"test": None}):
        with pytest.raises(ValueError):
            pf.period_runs([good | bad])
