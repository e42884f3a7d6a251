import hashlib
import random
import re

from tidewell.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(25)] + ["é", "日本"]
    items = [(i, rng.choice((" ", ", ", "-")).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(2, 30)]
    items += [(100, None), (101, ""), (102, "v1 V1"), (11, items[0][1])]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            passage = words(rng.choice(items[:28])[1])
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 2) :]
        docs.append((i, " ".join(w).upper() if i % 2 else ". ".join(w)))
    return docs + [(500, None), (501, ""), (502, "?!"), (503, "x " * 3000 + "v1-v1")], items


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(d, b, **options).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == brute(docs, items, options.get("window", 10))


def test_matches_brute_force(spark):
    check(spark, *tables(1))


def test_several_passes_and_short_windows(spark):
    check(spark, *tables(2), window=3, table_bytes=3000)


def test_clean_rows_keep_their_columns(spark):
    docs, items = tables(3)
    d = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in docs], "doc_id long, text string, kept boolean")
    clean = dc.clean_of_benchmarks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == [r[0] for r in brute(docs, items) if not r[5]]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.contaminated) for r in dc.contamination(d, none).collect()] == [(2, False)]
    assert dc.contamination(d.limit(0), none).count() == 0
