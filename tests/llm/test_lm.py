import math
import random
import re
from collections import Counter

from tidewell.llm.lm import cross_entropy_difference


def brute(rows, target, weight=0.7):
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for i, t in rows}
    vocabulary = {w for ws in words.values() for w in ws} | {None}  # None: a word that no document has
    losses = {}
    for name, ids in (("target", target), ("background", set(words))):
        one = Counter(w for i in ids for w in words[i])
        after = {}
        for i in ids:
            for left, w in zip(words[i], words[i][1:]):
                after.setdefault(left, Counter())[w] += 1
        alone = {w: (one[w] + 1) / (sum(one.values()) + len(vocabulary)) for w in vocabulary}
        assert math.isclose(sum(alone.values()), 1)
        for row in after.values() if len(vocabulary) < 50 else ():
            assert math.isclose(sum(weight * row[w] / sum(row.values()) + (1 - weight) * alone[w] for w in vocabulary), 1)

        def chance(left, w):
            row = after.get(left)
            return alone[w] if row is None else weight * row[w] / row.total() + (1 - weight) * alone[w]

        losses[name] = {i: sum(-math.log(alone[w] if j == 0 else chance(ws[j - 1], w)) for j, w in enumerate(ws)) for i, ws in words.items()}
    return {i: (len(ws), losses["target"][i], losses["background"][i]) for i, ws in words.items()}


def test_chances_after_each_word_add_up_to_1(spark):
    """Read from the losses themselves: a document of two words less that of its first word."""
    rnd = random.Random(3)
    words = list("abcdefgh")
    texts = [w for w in words] + [f"{x} {y}" for x in words for y in words]
    texts += [" ".join(rnd.choice("aaabbcd") for _ in range(rnd.randrange(9))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, len(texts), 3)], "doc_id long")
    out = {texts[r.doc_id]: r for r in cross_entropy_difference(docs, good).collect()}
    total = Counter(w for i, t in enumerate(texts) for w in t.split()), Counter(w for i, t in enumerate(texts) if i % 3 == 0 for w in t.split())
    for model, counts in zip(("background_loss", "target_loss"), total, strict=True):
        unseen = 1 / (counts.total() + len(words) + 1)
        assert math.isclose(sum(math.exp(-out[w][model]) for w in words) + unseen, 1)
        for x in words:
            assert math.isclose(sum(math.exp(out[x][model] - out[f"{x} {y}"][model]) for y in words) + 0.3 * unseen, 1)


def test_against_brute_force(spark):
    rows = [(i, " ".join(["the cat sat", "a dog ran off", "the dog sat", "on the mat"][(i + j * j) % 4] for j in range(i % 9))) for i in range(60)] + [(100, None), (101, "the " * 300_000), (102, "!!"), (7, "the cat"), (None, "once mat")]
    docs = spark.createDataFrame([(i, t, i, None) for i, t in rows], "doc_id long, text string, chunk long, kind string")
    good = [i for i in range(0, 60, 3)]
    out = cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in [*good, good[0]]] + [(None,)], "doc_id long")).collect()
    # rows of one id are in the target alike
    expected = brute([(n, t) for n, (_, t) in enumerate(rows)], {n for n, (i, _) in enumerate(rows) if i in good})
    assert len(out) == len(rows)
    out = [r for i, _ in rows for r in out if r.doc_id == i and i != 7]
    expected = {i: expected[n] for n, (i, _) in enumerate(rows)}
    for r in out:
        n, target, background = expected[r.doc_id]
        assert r.n_words == n
        assert math.isclose(r.target_loss, target, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.background_loss, background, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, (background - target) / max(n, 1), rel_tol=1e-9, abs_tol=1e-9)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert cross_entropy_difference(empty, empty.select("doc_id")).count() == 0


def test_every_word_and_bigram_counts(spark):
    # 80,000 words that all occur twice, each in its one bigram or two: more than 16 bits hold, and all of one count
    docs = spark.range(800).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 199), j -> concat('w', (id % 400) * 200 + j)), ' ') AS text")
    good = set(range(0, 800, 3))
    out = {r.doc_id: r for r in cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}

    def loss(n, total):
        p = (n + 1) / (total + 80_001)
        return -math.log(p) - 199 * math.log(0.7 + 0.3 * p if n else p)

    assert len(out) == 800
    for i, r in out.items():
        assert math.isclose(r.background_loss, loss(2, 160_000), rel_tol=1e-9)
        assert math.isclose(r.target_loss, loss((i % 400 in good) + (i % 400 + 400 in good), 200 * len(good)), rel_tol=1e-9)
