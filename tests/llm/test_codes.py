import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import codes
from tidewell.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Whole numbers of Python throughout; all vectors of one length."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    start = {}
    for (i, _, _), c in sorted(zip(kept, cut, strict=True), key=lambda t: (t[0][0] is None, t[0][0] or 0)):
        if i is not None:
            start.setdefault(i, c)
    start = list(start.values())[:entries]
    books = [[c[p] for c in start] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, near, strict=True) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(m[j] for m in mine) // len(mine) for j in range(size)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in a) for a in assign()]
    of_label = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        of_label[label] = of_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in a), e, of_label[label], sha) for (i, _, label), a, e in zip(kept, assign(), error, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [None, 3, 11])
def test_products_are_exact(bits):
    rng = np.random.default_rng(3)
    for top in (1, 1 << 12, 1 << 27):
        x, c = (rng.integers(-top, top + 1, (n, 8)) for n in (50, 16))
        want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in c] for r in x]
        assert codes.exact_products(x, c, bits).tolist() == want
    width = codes.limb_bits(8)
    assert ((1 << width) - 1) ** 2 * 8 < 1 << 53
    assert len(codes.limbs(np.array([-(1 << 27), 1 << 27]), width)) == 2  # large components do split


@pytest.mark.parametrize("top", [1.0, 3000.0])
def test_against_brute_force(spark, top):
    rnd = random.Random(6)
    rows = [(i * 3, [rnd.uniform(-top, top) if rnd.random() < 0.8 else 0.25 for _ in range(16)], rnd.choice([1, 2, None])) for i in range(120)]
    rows += [rows[5], rows[5], (None, rows[7][1], 2), (-5, None, 1), (-4, [None] * 16, 1), (-3, [float("nan")] * 16, 1), (-2, [1.0] * 15 + [float("-inf")], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("of_label", F.lit(1)).withColumn("code", F.lit("extra"))
    assert got(codes.compressed(df)) == brute(rows)


def test_few_rows_odd_lengths_and_empty(spark):
    rows = [(1, [0.5] * 8, None), (2, [0.5] * 8, 1), (3, [-0.1] * 8, 1)]
    odd = [(0, [], 1), (4, [1.0] * 7, 2)]
    out = got(codes.compressed(spark.createDataFrame(rows + odd, SCHEMA)))
    want = brute(rows)
    assert [r for r in out if r[1] is not None] == want
    assert sorted(r[0] for r in out if r[1] is None) == [0, 4] and all(r[2] is None for r in out if r[1] is None)
    assert got(codes.compressed(spark.createDataFrame([], SCHEMA))) == []
    only = got(codes.compressed(spark.createDataFrame([(None, [0.5] * 8, 1)], SCHEMA)))
    assert only[0][:4] == (None, None, None, None)
    with pytest.raises(Exception, match="64 bits"):
        codes.compressed(spark.createDataFrame([(1, [1e9] * 8, 1)], SCHEMA))


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = QUERIES["op13_vector_codes"](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op13_vector_codes']})").fetchall()
    assert got(df) == sorted(want, key=str)
