import hashlib
import random
import re

import numpy as np
import pytest

from tidewell.llm import pii


@pytest.fixture(scope="module")
def tagger():
    return pii.trained_tagger()


def brute(text):
    out = []
    for n, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
                if not 16 <= len(d) <= 19 or odd % 10:
                    continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((n, f"{kind}:{m.start()}:{m.end()}"))
    return out


def test_base_spans_match_brute_force_and_stay(spark, tagger):
    texts = ["mail a.b+c@x.org, 10.0.0.255 4111 1111 1111 1111 +1 (578) 555-6437 4918187128635271", "é" * 50 + " 1.2.3.4.5 300.1.1.1 x@y a@b.c", "", None, "no data here", "+12 4111111111111111", "q@" * 40 + "z.z", "lorem " * 20000 + "1.2.3.4 end"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, texts[0], None)]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string"), tagger=tagger).collect()
    assert len(out) == len(rows)
    for r in out:
        t = texts[r.doc_id if r.doc_id is not None else 0] or ""
        spans = brute(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(n == k for n, _ in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(s for _, s in spans).encode()).hexdigest()
        assert {s for _, s in spans} <= set(r.spans.split(","))
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string"), tagger=tagger).count() == 0


def test_tagger_finds_held_out_spans(tagger):
    rng = random.Random(77)
    made = [pii.labelled_text(rng, 48) for _ in range(400)]
    y = np.array([labels for _, labels in made])
    found = tagger.decode(np.array([pii.char_classes(t) for t, _ in made]))
    assert (found == y).mean() > 0.93 and (found[y > 0] == y[y > 0]).mean() > 0.85


def test_labels_come_from_the_most_central_window(tagger):
    rng = random.Random(5)
    text = pii.labelled_text(rng, 400)[0]
    c = pii.char_classes(text)
    (labels,) = pii.tag(tagger, [c], 96, 64, 7)
    starts = list(range(0, len(c) - 32, 64))
    assert starts[-1] + 96 >= len(c)
    one_by_one = [tagger.decode(np.append(c[s : s + 96], np.full(max(0, s + 96 - len(c)), pii.PAD, np.uint8))[None])[0] for s in starts]
    for i in range(len(c)):
        own = [(min(i - s, s + 95 - i) if 0 < s and s + 96 < len(c) or s + 95 - i < i - s else 96, -s) for s in starts if s <= i < s + 96]
        assert labels[i] in {one_by_one[starts.index(-s)][i + s] for _, s in own}
    assert pii.spans_of(np.array([1, 2, 2, 0, 0, 4, 4, 3, 4, 2])) == [(0, 0, 3), (1, 5, 7), (1, 7, 9), (0, 9, 10)]
    assert pii.spans_of(np.zeros(5, np.int8)) == []


def test_decoding_is_the_best_path(tagger):
    x = np.array([pii.char_classes(pii.labelled_text(random.Random(i), 12)[0]) for i in range(20)])
    scores, labels = tagger.scores(x).transpose(2, 0, 1).astype(float), tagger.decode(x)

    def value(s, path):
        return s[np.arange(len(path)), path].sum() + tagger.first[path[0]] + tagger.go[path[:-1], path[1:]].sum()

    for s, path in zip(scores, labels, strict=True):
        ahead = np.zeros(9)
        for i in range(11, 0, -1):  # best value of what follows each label
            ahead = (tagger.go + s[i] + ahead).max(axis=1)
        assert np.isclose(value(s, path), (s[0] + tagger.first + ahead).max(), rtol=1e-4)


def test_scores_for_decoding_are_those_of_training(tagger):
    x = np.array([pii.char_classes(pii.labelled_text(random.Random(i), 30)[0]) for i in range(5)])
    assert np.allclose(tagger.scores(x).transpose(2, 0, 1), tagger._run(x)[0], atol=1e-3)


def test_written_addresses_in_plain_prose_are_found(spark, tagger):
    texts = ["contact john.smith at mail.example.com today", "x " * 200 + "write to anna [at] web.net please", "no address at all. none."]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger=tagger).collect()
    got = {r.doc_id: r.spans for r in out}
    assert got[0].startswith("email:") and got[1].startswith("email:") and got[2] == ""


def test_long_runs_take_linear_time():
    for text in ("a" * 1_000_000 + "@", "1" * 1_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "a@" * 500_000):
        assert [x for x in pii.base_spans(text) if x[0] != 1] == []
