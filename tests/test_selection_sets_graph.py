import itertools
import random

import numpy as np
import pytest

from tidewell.operators import evaluation as ev
from tidewell.operators import graph as gr
from tidewell.operators import selection as sl
from tidewell.operators import sets as st

ODD = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 1.0, 1.0 + 2e-16, -1.0]


def test_quantiles_equal_a_sort(spark):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=501).tolist(), "ties": rng.integers(0, 3, 200).astype(float).tolist(), "odd": ODD, "one": [7.0], "cauchy": rng.standard_cauchy(300).tolist(), None: [2.0, 4.0]}
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("ties", None, "x"), ("ties", float("nan"), "x"), ("none", None, "x")]
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in sl.quantiles(spark.createDataFrame(rows, "g string, v double, q string"), ["g"], "v", at).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        s = sorted(vs)
        for share, q in zip(at, got[g].q):
            place = share * (len(s) - 1)
            low, high, part = s[int(np.floor(place))], s[int(np.ceil(place))], place - np.floor(place)
            want = low if low == high or part == 0 else low * (1 - part) + high * part
            assert q == want or q == pytest.approx(want, rel=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert sl.quantiles(empty, ["g"], "v", [0.5]).count() == 0
    assert sl.winsorized(empty, "v", 3.0, ["g"]).count() == 0


def test_winsorized_and_clipped_keep_rows(spark):
    rows = [("a", float(i)) for i in range(100)] + [("a", 1e6), ("a", None), (None, 5.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    held = [r.v for r in sl.winsorized(frame, "v", 2.0, ["g"]).collect()]
    assert len(held) == len(rows) and held.count(None) == 1
    assert max(v for v in held if v is not None) == 50.0 + 2 * 25.0
    cut = [r.v for r in sl.clipped(frame, "v", 0.0, 0.5, ["g"]).collect()]
    assert len(cut) == len(rows) and max(v for v in cut if v is not None) == 50.0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_equal_all_pairs_with_a_token_in_every_row(spark, threshold):
    rng = random.Random(5)
    rows = [(i, ["the", *(rng.choice("abcdefghijkl") for _ in range(rng.randrange(0, 9)))]) for i in range(150)]
    rows += [(1000, None), (1001, []), (1002, [None]), (1003, ["the", "the", None])]
    frame = spark.createDataFrame(rows, "id long, t array<string>").withColumnRenamed("t", "n")
    named = {}
    for i, t in sorted(rows):
        s = frozenset(x for x in t or [] if x)
        if s:
            named.setdefault(s, i)
    want = {}
    for (a, i), (b, j) in itertools.combinations(named.items(), 2):
        jaccard = len(a & b) / len(a | b)
        if jaccard >= threshold - 1e-9:
            want[min(i, j), max(i, j)] = jaccard
    got = {(r.a, r.b): r.jaccard for r in st.similar_sets(frame, "id", "n", threshold).collect()}
    assert got == pytest.approx(want)
    members = {r["id"]: r["class"] for r in st.classes(frame, "id", "n").collect()}
    assert members == {i: named[frozenset(x for x in t if x)] for i, t in rows if t and any(t)}


def _walk(edges, starts, k):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hop, front = {s: 0 for s in starts}, set(starts)
    for h in range(1, k + 1):
        front = {n for f in front for n in near.get(f, ()) if n not in hop}
        hop |= {n: h for n in front}
    return hop


def test_hops_of_each_start_past_one_mask(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(160)] + [(3, 3), (1, 2), (1, 2)]
    frame = spark.createDataFrame(edges, "a long, b long")
    starts = [*range(70), 500]
    got = {(r.start, r.node): r.hop for r in gr.hops_of_each(frame, starts, 3).collect()}
    assert got == {(s, n): h for s in starts for n, h in _walk(edges, [s], 3).items()}
    some = [1, 5, 9]
    both = set.intersection(*({*_walk(edges, [s], 3)} for s in some)) - set(some)
    assert {r.node for r in gr.neighbourhoods(frame, some, 3).collect()} == both
    odd = spark.createDataFrame([(1,), (5,), (None,)], "node long")
    assert {r.node: r.hop for r in gr.hops(frame, odd, 2).collect()} == _walk(edges, [1, 5], 2)


def test_a_hub_is_split(spark):
    hub = spark.range(1, 100_001).selectExpr("0L AS a", "id AS b")
    tail = spark.createDataFrame([(100_000, 200_000)], "a long, b long")
    found = gr.hops(hub.unionByName(tail), spark.createDataFrame([(7,)], "node long"), 3)
    counts = {r.hop: r["count"] for r in found.groupBy("hop").count().collect()}
    assert counts == {0: 1, 1: 1, 2: 99_999, 3: 1}


def test_labelled_hops_stop_at_blocked_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 6)], "a long, b long")
    labels = spark.createDataFrame([(1, "x"), (2, "ok"), (3, "shut"), (4, "ok"), (5, "x"), (6, "ok")], "node long, label string")
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.hop for r in gr.labelled_hops(edges, labels, start, 5, ["ok"], ["shut"]).collect()} == {1: 0, 2: 1, 3: 2}


def test_recent_decay(spark):
    import datetime

    def days(values):
        return [(datetime.date(2020, 1, 1) + datetime.timedelta(i), v) for i, v in enumerate(values)]

    cases = {
        "short": [1.0] * 60 + [0.1] * 59,
        "flat": [1.0] * 120,
        "fallen": [1.0] * 60 + [0.8] * 60,
        "end": [1.0] * 100 + [0.0] * 20,
        "old": [9.0] * 50 + [1.0] * 120,
        "zero": [0.0] * 60 + [-1.0] * 60,
        "null": [1.0] * 60 + [0.1] * 59 + [None],
        "nan": [1.0] * 60 + [0.1] * 59 + [float("nan")],
    }
    rows = [(n, d, v) for n, vs in cases.items() for d, v in days(vs)]
    got = {r.factor: r.recent_decay for r in ev.recent_decay(spark.createDataFrame(rows, "factor string, date date, ic double")).collect()}
    assert got == {n: n in ("fallen", "end") for n in cases}


def test_failure_codes_without_the_optional_columns(spark):
    rows = spark.createDataFrame([("a", 0.1, 0.1, "none", None), ("b", -0.1, 0.9, "critical", ["high_similarity"]), ("c", None, None, None, ["low_coverage"])], "factor string, rank_ic_test double, turnover double, lookahead_risk string, reasons array<string>")
    got = {r.factor: (r.reason_codes, r.reason_group, r.reason_severity, r.action_type) for r in ev.failure_codes(rows).collect()}
    assert got == {
        "a": ("WEAK_OOS_IC", "predictive_power", "low", "change_window"),
        "b": ("LOOKAHEAD_DETECTED,HIGH_SIMILARITY,HIGH_TURNOVER,WEAK_OOS_IC", "data_leakage", "high", "discard"),
        "c": ("LOW_COVERAGE", "data_quality", "medium", "change_window"),
    }
