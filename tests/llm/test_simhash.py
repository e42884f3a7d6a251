import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import simhash
from tidewell.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=2):
    """(doc_id, fingerprint, component) of rows by comparing all pairs."""
    bits = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= distance) + i + 1:
            root[top(int(j))] = top(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, f"{int(bits[i]):016x}", least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_every_word_has_one_home_and_covers_all():
    cover = simhash.Cover(2)
    assert (cover.upto[1] == 1).all()  # the code is perfect
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, int(rng.integers(0, 3)), replace=False):
            y ^= 1 << int(b)
        bits = np.array([x, y], np.uint64)
        home, all_ = [set(), set()], [set(), set()]
        for row, anchor, is_home in simhash.anchors(bits, cover, 2):
            for r, a in zip(row.tolist(), anchor.tolist(), strict=True):
                assert a not in all_[r]  # each anchor once
                all_[r].add(a)
                home[r] |= {a} if is_home else set()
        assert len(home[0]) == len(home[1]) == 1
        assert home[0] <= all_[1] and home[1] <= all_[0]


@pytest.mark.parametrize("home_rows", [1 << 15, 3])
def test_against_all_pairs(spark, home_rows):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "No id here, yet words"), (900, None), (901, ""), (902, " \t\r\n\x0b "), (903, "One"), (904, "one  "), (905, "A b"), (905, "A b"), (906, "été Éclair ünï ÇA")]
    for k in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 200]))]
        for i in range(rnd.choice([1, 2, 6])):
            t = list(base)
            for _ in range(i):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((k * 10 + i, rnd.choice([" ", "  ", "\n"]).join(t)))
    rows.append((950, " ".join(rnd.choice(words) for _ in range(80_000))))
    rows.append((951, rows[-1][1] + " w1"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bits", F.lit("extra")).withColumn("root", F.lit(1))
    assert got(simhash.simhash_duplicates(df, home_rows=home_rows)) == brute(rows)


def test_near_group_in_parts_equals_all_pairs(spark):
    """Fingerprints around one point: every anchor near it is crowded."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 63))
    bits = {centre}
    while len(bits) < 600:
        x = centre
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            x ^= 1 << int(b)
        bits.add(x)
    signed = np.array(sorted(bits), np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(b,) for b in signed], "bits long")
    cover = simhash.Cover(2)
    for home_rows in (1 << 15, 5):
        parts = simhash._parts(distinct, cover, home_rows)
        assert (parts.max() > 1) == (home_rows == 5)
        links = {tuple(r) for r in simhash._links(simhash._sent(distinct, cover, 2, parts), 2).collect()}
        x = np.array(signed, np.int64).view(np.uint64)
        want = np.arange(len(x))
        for edges, label in ((None, want), (links, np.arange(len(x)))):
            pairs = [(signed.index(a), signed.index(b)) for a, b in edges] if edges is not None else [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2)]
            for i, j in pairs:
                assert np.bitwise_count(x[i] ^ x[j]) <= 2
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
        assert (label == want).all()


def test_query_and_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_simhash"](spark, sf)) == brute(rows)
    assert got(simhash.simhash_duplicates(spark.createDataFrame([], SCHEMA))) == []
