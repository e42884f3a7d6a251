import random
import re

import pytest

from tidewell.llm import neardup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def documents(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    seeds = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] + common * rng.randint(0, 1) for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i * 7 + 3, rng.choice((" ", "\n", "\t ")).join(words).upper() if i % 5 == 0 else " ".join(words)))
    return out + [(1, None), (2, ""), (4, " \t"), (5, "Ünï  x"), (6, "ünï  x"), (8, "two words"), (9, "TWO  words")]


@pytest.mark.parametrize(("tile", "hot_rows"), [(4, 1 << 20), (256, 1 << 20), (8, 6)])
def test_matches_brute_force(spark, tile, hot_rows):
    rows = documents(tile, 160)
    docs = spark.createDataFrame([(i, t, "x", 0, b"") for i, t in rows], "doc_id long, text string, key string, n int, bitmap binary")
    got = neardup.near_duplicates(docs, tile=tile, hot_rows=hot_rows).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_large_group_of_copies_and_repeated_rows(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(i, text) for i in range(300)] + [(5, text), (5, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.component_id for r in got if r.n_shingles] == [0] * 301
    assert [(r.doc_id, r.component_id) for r in got if not r.n_shingles] == [(5, 5)]


def test_one_document_of_each_group_stays(spark):
    rows = documents(3, 80)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = neardup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(rows) if d == c)


def test_null_ids_and_empty_table(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(None, text), (3, text), (None, "alone")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(None, 2, 3), (3, 2, 3), (None, 1, None)}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_with_unlike_texts_all_stay(spark):
    t, u = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(3, t, "a"), (5, t, "b"), (5, u, "c"), (5, u, "c"), (None, u, "d"), (None, "alone here", "e"), (6, None, "f"), (6, None, "f"), (6, "word " * 300_000, "g")], "doc_id long, text string, _id string")
    kept = neardup.distinct_documents(docs)
    got = sorted(((r.doc_id, r.text[:9] if r.text else r.text, r._2) for r in kept.select("doc_id", "text", kept._id.alias("_2")).collect()), key=str)
    assert got == sorted([(3, t[:9], "a"), (5, u[:9], "c"), (None, "alone her", "e"), (6, None, "f"), (6, None, "f"), (6, "word word", "g")], key=str)
    assert neardup.distinct_documents(docs.limit(0)).count() == 0
