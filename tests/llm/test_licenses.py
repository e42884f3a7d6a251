import math
import random
import re

from tidewell.llm.licenses import APACHE_NOTICE, BASE, CATALOGUE, MIT_GRANT, WORD, license_scan


def test_base_places_match_brute_force(spark):
    texts = ["Released under the MIT License.", "under the mit license under the mit license cc-by-nc apache LICENSE, version 2.0", "mit mit license the under", "", None, "cc by", "CC BY NC cc by nc", "x " * 5000 + "Licensed under the Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3.", "the GNU General Public thing, version 3", "nc cc", "Écc by nc"]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(1, texts[1], 0), (None, texts[0], None)]
    out = license_scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert len(out) == len(rows)
    for r, (i, t, _) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1) == bool(at) or r.labels
    by = {r.doc_id: r for r in out}
    assert by[8].labels == "gpl-3" and by[9].labels == "" and by[4].labels == ""


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def template_labels(texts, rare=4, least_vote=0.75):
    """Labels by looking at every offset of every template in every text."""
    docs = [words(t) for t in texts]
    held = {w: sum(w in d for d in map(set, docs)) for t in CATALOGUE for w in t.words}
    idf = {w: max(math.log((1 + len(docs)) / (1 + n)), 1e-6) for w, n in held.items()}
    out = []
    for d in docs:
        labels = set()
        for t in CATALOGUE:
            best = sorted(set(t.words), key=lambda w: (-math.log((1 + len(docs)) / (1 + held[w])), w))[:rare]
            at = {w: t.words.index(w) for w in best}
            for s in range(len(d)):
                if s + at[best[0]] < len(d) and d[s + at[best[0]]] == best[0]:
                    vote = sum(idf[w] for w in best if s + at[w] < len(d) and d[s + at[w]] == w) / sum(idf[w] for w in best)
                    inside = f" {' '.join(d[s : s + len(t.words) + 2])} "
                    if vote >= least_vote and all(f" {k} " in inside for k in t.keys):
                        labels.add(t.label)
        out.append(labels)
    return out


def test_templates_match_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for i in range(60):
        t = words(rng.choice(CATALOGUE).text)
        for _ in range(rng.choice((0, 0, 1, 3, 10))):
            t[rng.randrange(len(t))] = rng.choice(("x", "software", "license", "the"))
        if i % 4 == 0:
            del t[rng.randrange(len(t)) :]
        texts.append(" ".join(["lorem", "the", "software"] * rng.randint(0, 5) + t + ["end"] * rng.randint(0, 3)))
    texts += [MIT_GRANT, APACHE_NOTICE * 2, "plain text"]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, want in enumerate(template_labels(texts)):
        assert set(got[i].labels.split(",")) - {""} == want | (set(got[i].base_labels.split(",")) - {""})
    assert got[60].labels == "mit" and "apache-2" in got[61].labels and got[62].score == 0
