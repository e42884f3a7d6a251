"""Toxicity and quality: held-out accuracy, located sentences, and the defined results of odd rows."""

import random

from tidewell.llm import quality, toxicity

BAD = ["grokking", "vilesome", "harrowed"]


def corpus(seed, n=600):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "lo", "mi", "tu", "re") for b in ("na", "der", "st", "gol", "pi", "ke")]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(plain) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 8))]
        bad = i % 5 == 0
        if bad:
            sentences.insert(rng.randint(0, len(sentences)), f"{rng.choice(plain)} {rng.choice(BAD)} {rng.choice(plain)}")
        rows.append((i, ". ".join(sentences) + ".", "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_separates_and_locates(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, learn=marks.doc_id % 4 != 2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if i % 4 == 2]
    assert sum((r.score >= 0.3) == (y == 1) for r, y in held) / len(held) > 0.97
    text = {i: t.encode() for i, t, _ in rows}
    for r, y in held:
        if y and r.score >= 0.5:
            assert any(b.encode() in text[r.doc_id][s.start : s.end] for s in r.sentences for b in BAD)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.3}


def test_toxicity_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "?! ..."), (None, "plain words"), (4, "long words " * 200_000), (4, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one_kind = toxicity.fit(docs, spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, toxic int"))
    got = toxicity.score(docs, one_kind).collect()
    assert len(got) == 6 and all(0 <= r.score < 0.3 for r in got if r.doc_id != 4)
    none = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_quality_separates_held_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        good = i % 2
        text = " ".join(words) if good else " ".join(f"{w.upper()}!!{rng.randint(0, 99)} {w} {w}" for w in words)
        rows.append((i, text))
        labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks, learn=marks.doc_id % 5 != 0)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(got[i] >= 0.5, y == 1) for i, y in labels if i % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (None, "words here"), (3, "x " * 300_000)], "doc_id long, text string")
    marks = spark.createDataFrame([(3, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, marks)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    unlearned = quality.fit(docs, marks.limit(0))
    assert {r.score for r in quality.score(docs, unlearned).collect()} == {0.5}
    assert quality.score(docs.limit(0), unlearned).count() == 0


def test_toxicity_of_clean_text_does_not_grow_with_its_length(spark):
    rows, labels = corpus(5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    fitted = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    empty = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    long = spark.createDataFrame([(1, "bana loder stmi. " * 20_000), (2, "bana loder stmi. " * 20_000 + "bana grokking loder.")], "doc_id long, text string")
    assert {r.doc_id: r.score >= 0.3 for r in toxicity.score(long, fitted).collect()} == {1: False, 2: True}
    assert all(r.score == 0 for r in toxicity.score(long, empty).collect())


def test_long_texts_and_rare_labels_do_not_end_the_sample(spark):
    docs = spark.createDataFrame([(i, "long " * 4000 if i % 2 else f"short {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 398)) for i in range(400)], "doc_id long, toxic int")
    corpus_, y = toxicity.labelled_sample(docs, labels, "toxic", None, 400, 10_000)
    assert {t for t in corpus_ if t.startswith(b"short")} == {f"short {i}".encode() for i in range(0, 400, 2)} and y.sum() == 1
    assert toxicity.labelled_sample(docs, labels, "toxic", None, 16, 10_000)[1].sum() == 1
    only_long = spark.createDataFrame([(1, "long " * 4000), (2, "long " * 4000)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.labelled_sample(only_long, marks, "toxic", None, 8, 10_000)[1]) == [0, 1]


def test_toxicity_scores_match_a_plain_noisy_or(spark):
    import math
    import re

    import numpy as np

    from tidewell.llm import textbytes as tb

    rows, labels = corpus(9, 120)
    rows += [(500, "Grokking! " * 3, "s"), (501, "x " * 200_000, "s"), (502, "?", "s"), (503, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sentences string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def features(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        w = tb.words(tb.Slice(0, 1, raw, np.array([0, len(raw)])), tb.ALNUM_WORDS)
        return [int(w.hashes(p)[0]) + k & (1 << 64) - 1 for k, p in enumerate(toxicity.PREFIXES) if not p or len(raw) >= p]

    def plain(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            own = {f for word in re.findall(r"[a-z0-9]+", sentence) for f in features(word)} & weight.keys()
            if own:
                clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weight[f] for f in own))))
        return 1 - clean

    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows:
        assert math.isclose(got[i], plain(text), rel_tol=1e-6, abs_tol=1e-9), i


def test_quality_votes_match_brute_force(spark):
    import numpy as np
    import pyarrow as pa

    from tidewell.llm import textbytes as tb

    rng = random.Random(6)
    texts = [" ".join(rng.choice(("ab", "CD!!", "e1", "foo", "Bar")) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["x " * 100_000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 3 == 0) for i in range(100)], "doc_id long, quality boolean").selectExpr("doc_id", "int(quality) AS quality"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, t in enumerate(texts):
        (s,) = tb.slices(pa.array([t.encode()], pa.binary()), lower=False)
        mine = model.latent(quality.term_matrix(s))[0]
        near = sorted(((float(mine @ v), float(y)) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)
        edge = near[model.neighbours - 1][0]
        votes = [(max(c, 0) ** 4, y) for c, y in near if c > edge - 1e-12]  # all of one edge cosine may vote
        total = sum(v for v, _ in votes[: model.neighbours])
        if len(votes) == model.neighbours and total > 1e-9:
            assert np.isclose(got[i], sum(v * y for v, y in votes) / total, atol=1e-6)
        assert 0 <= got[i] <= 1
    assert quality.score(docs.where("doc_id < 0"), model).count() == 0


def test_sample_ignores_labels_without_documents_and_repeats(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, f"again {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    sample, y = toxicity.labelled_sample(docs, labels, "toxic", None, 20, 1 << 20)
    assert len(sample) == 20 and y.sum() == 10
