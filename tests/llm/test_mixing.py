"""Mixing against the fluid targets, followed step by step in exact fractions."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from tidewell.llm import mixing


def fluid_targets(blocks, weights):
    """Blocks that the fluid mix has served of each source after every slot, by serving what is left in proportion."""
    served = {s: Fraction(0) for s in blocks}
    for _ in range(sum(blocks.values())):
        left = Fraction(1)
        while left:
            open_ = [s for s in blocks if served[s] < blocks[s]]
            total = sum(Fraction(weights[s]) for s in open_)
            step = min([left, *((blocks[s] - served[s]) / (Fraction(weights[s]) / total) for s in open_)])
            for s in open_:
                served[s] += step * Fraction(weights[s]) / total
            left -= step
        yield dict(served)


def worst_lag(order, blocks, weights):
    seen, worst = Counter(), Fraction(0)
    for s, target in zip(order, fluid_targets(blocks, weights), strict=True):
        seen[s] += 1
        worst = max(worst, *(abs(seen[x] - target[x]) for x in blocks))
    assert seen == Counter(blocks)
    return worst


@pytest.mark.parametrize(
    ("blocks", "weights"),
    [
        ({"a": 40, "b": 30, "c": 20}, {"a": 5, "b": 3, "c": 2}),
        ({"a": 600, "b": 600}, {"a": 0.5004, "b": 0.4996}),
        ({"a": 900, "b": 3}, {"a": 0.9996, "b": 0.0004}),
        ({"a": 1, "b": 2, None: 60}, {"a": 0.7, "b": 0.2, None: 0.1}),
        ({str(i): 5 + i % 7 for i in range(20)}, {str(i): (i + 1) ** 0.5 for i in range(20)}),
    ],
)
def test_every_source_is_within_one_block_after_every_slot(blocks, weights):
    assert worst_lag(mixing.schedule(blocks, weights), blocks, weights) < 1


def test_random_mixes_stay_within_one_block():
    rng = random.Random(5)
    for _ in range(30):
        blocks = {str(i): rng.randint(1, 40) for i in range(rng.randint(1, 9))}
        weights = {s: rng.random() ** 3 + 1e-4 for s in blocks}
        assert worst_lag(mixing.schedule(blocks, weights), blocks, weights) < 1


def test_mix_places_every_row_once(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None, "x", "word " * 20_000 if i == 5 else "") for i in range(3000)] + [(None, None, None, None)] * 2 + [(None, "hot", str(i), "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string, rank string")
    weights = {"hot": 2.0, "s1": 1.0, "s2": 0.5, "s3": 0.5, "s4": 1, "s0": 1, None: 1}
    mixed = mixing.mixed(docs, weights=weights, block_rows=4)
    assert mixed.columns == [*docs.columns, "mix_block", "_mix_slot", "mix_position"]
    out = mixed.collect()
    assert sorted(r.mix_position for r in out) == list(range(len(rows)))
    assert Counter(r[:4] for r in out) == Counter(rows)
    order = [s for _, s in sorted({(r["_mix_slot"], r.source) for r in out})]
    blocks = {s: -(-n // 4) for s, n in Counter(r[1] for r in rows).items()}
    assert worst_lag(order, blocks, weights) < 1
    by_position = sorted(out, key=lambda r: r.mix_position)
    assert [r["_mix_slot"] for r in by_position] == sorted(r["_mix_slot"] for r in out)
    fewer = mixing.mixed(docs, block_rows=4, most_slots=50).agg({"_mix_slot": "max", "mix_position": "max"}).first()
    assert fewer[0] < 60 and fewer[1] == len(rows) - 1


def test_order_is_kept_and_rows_return(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", str(i)) for i in range(200)], "doc_id long, source string, mix_position string")
    assert sorted(mixing.in_mix_order(docs).collect()) == sorted(docs.collect())


def test_empty_and_bad_weights(spark):
    docs = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mixed(docs).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule({"a": 1}, {"a": 0})
