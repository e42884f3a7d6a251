import numpy as np

from tidewell.llm.ann import nearest


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:900] = x[100]  # one very common vector
    ids = np.arange(3000)
    docs = spark.createDataFrame([(int(i), [float(v) for v in row], "c") for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in nearest(docs, block_rows=700, query_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute(ids, x.astype(np.float64), 20)
    assert got.keys() == expected.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits / (20 * len(expected)) >= 0.9
    for q, found in got.items():
        assert len(found) == 20
        for i, s in found:
            assert np.isclose(s, x[i].astype(float) @ x[q].astype(float), rtol=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_odd_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (40, [3.0]), (None, [1.0, 1.0]), (7, [2.0, 9.0]), (8, [])]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(0, 1, 1, 2.0), (0, 2, 7, 2.0), (40, 1, 6, 3.0)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
