"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
its word features, a document's the noisy-or of its sentences' scores; the
weights are trained from document labels only, and the sentence scores then
tell where the offending sentences are.  Features are words and their first
four to eight bytes, which covers inflected forms.  A sentence without any
feature of the model adds nothing, so that a document's length alone says
nothing about it.

The model is fitted on a bounded sample of labelled rows (`most_rows`,
`most_bytes`), so what is broadcast has a fixed bound.  Scoring is one narrow
pass over the documents without a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import filtered, stored, texts

PREFIXES = (None, 4, 5, 6, 7, 8)
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[list(b".!?\n")] = True


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None, most_rows: int, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and 0/1 labels of at most most_rows documents, in the order of a hash of their ids.

    Repeated labels of a document count as their maximum; null labels and
    texts, and labels without a document, are left out.  Of texts that repeat
    an id, the one of the smallest hash is taken.  The first 16 of each label
    come before all others, so that a rare one is there.  Texts longer than a
    64th of most_bytes come last, the shortest first, and what does not fit in
    most_bytes is left out; the first text of each label stays in any case.

    The choice is made on ids, hashes and lengths alone, one row an id, of which
    at most most_rows + 32 leave the executors; texts are then read for the
    chosen ids only.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    read = texts(docs).where("text is not null").withColumn("hash", F.xxhash64("text"))
    sizes = read.select("doc_id", F.struct("hash", F.length("text").cast("long").alias("bytes")).alias("of"))
    rows = sizes.groupBy("doc_id").agg(F.min("of").alias("of")).join(known, "doc_id")
    rows = rows.select("doc_id", "y", "of.*").withColumn("long", F.col("bytes") > most_bytes // 64)

    def first(some: DataFrame, count: int) -> DataFrame:
        return some.orderBy("long", F.when(F.col("long"), F.col("bytes")), F.xxhash64("doc_id"), "doc_id").limit(count)

    rows = stored(rows, "labelled")
    ahead = {r.doc_id: r for y in (0, 1) for r in first(rows.where(F.col("y") == y), 16).collect()}
    every = {r.doc_id: r for r in first(rows, most_rows).collect()}
    chosen, left, seen = [], most_bytes, set()
    for r in [r for r in ahead.values() if not r.long] + [r for r in every.values() if r.doc_id not in ahead or r.long] + [r for r in ahead.values() if r.long and r.doc_id not in every]:
        if r.y not in seen or len(chosen) < most_rows and r.bytes <= left:
            chosen.append((r.doc_id, r.hash, r.y))
            left -= r.bytes
            seen.add(r.y)
    of = docs.sparkSession.createDataFrame(chosen, "doc_id long, hash long, y int")  # most_rows + 2 rows at most
    kept = read.join(F.broadcast(of), ["doc_id", "hash"]).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    out = sorted((r.doc_id, bytes(r.text), r.y) for r in kept.toLocalIterator())
    return [x[1] for x in out], np.array([x[2] for x in out], np.float64)


def _sentences(s: tb.Slice) -> tuple[tb.Words, np.ndarray, np.ndarray]:
    """Words, the number of each word's sentence within the slice (ascending), and the row of each sentence with words."""
    w = tb.words(s, tb.ALNUM_WORDS)
    ends = SENTENCE_END[s.data]
    before = np.concatenate(([0], np.cumsum(ends)))[w.start]
    new = np.ones(len(w.start), bool)
    new[1:] = (before[1:] != before[:-1]) | (w.row[1:] != w.row[:-1])
    return w, np.cumsum(new) - 1, w.row[new]


def _features(w: tb.Words) -> list[np.ndarray]:
    out = []
    for k, p in enumerate(PREFIXES):
        h = w.hashes(p) + np.uint64(k)
        if p:
            h = np.where(w.end - w.start >= p, h, np.uint64(0))
        out.append(h)
    return out


@dataclass
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        table[(self.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return table

    def sentence_scores(self, w: tb.Words, sentence: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Logistic score of each sentence, 0 without a feature; a feature counts once in a sentence."""
        count = int(sentence[-1]) + 1 if len(sentence) else 0
        at, which = self.occurrences(w, sentence, table)
        return np.where(np.bincount(at, minlength=count) > 0, _sigmoid(self.bias + np.bincount(at, self.weights[which], minlength=count)), 0.0)

    def occurrences(self, w: tb.Words, sentence: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = []
        for h in _features(w):
            maybe = np.flatnonzero(table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.features, h[maybe]), len(self.features) - 1)
            same = self.features[slot] == h[maybe] if len(self.features) else np.zeros(0, bool)
            pairs.append(sentence[maybe][same] * max(1, len(self.features)) + slot[same])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.features)), both % max(1, len(self.features))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _noisy_or(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows))


def train(corpus: list[bytes], y: np.ndarray, steps: int = 300, rate: float = 0.1, shrink: float = 3e-5, least: int = 5, least_sigma: float = 5.0) -> ToxicityModel:
    """Fits the noisy-or model by Adam on the log loss of document labels.

    Features come from the sample: found in `least` positive documents or more,
    and that by `least_sigma` standard deviations more than chance would have it.
    With labels of one kind only, or none, every sentence scores 0.
    """
    empty = ToxicityModel(np.empty(0, np.uint64), np.empty(0), -8.0)
    if not 0 < y.sum() < len(y):
        return empty
    column = pa.array(corpus, pa.binary())

    def of_documents(label: int) -> Iterator[np.ndarray]:
        for s in tb.slices(column):
            w, _, _ = _sentences(s)
            every = np.array(_features(w))
            for r, (a, b) in enumerate(itertools.pairwise(w.first.tolist())):
                if y[s.lo + r] == label:
                    yield np.unique(every[:, a:b])

    features, positive = np.unique(np.concatenate([np.empty(0, np.uint64), *of_documents(1)]), return_counts=True)
    features, positive = features[positive >= least], positive[positive >= least]
    if not len(features):
        return empty
    negative = np.zeros(len(features))  # only features that positive documents have are counted
    for own in of_documents(0):
        slot = np.minimum(np.searchsorted(features, own), len(features) - 1)
        negative[slot[features[slot] == own]] += 1
    expected = (positive + negative) * y.mean()
    keep = (positive - expected >= least_sigma * np.sqrt(expected)) & (features != 0)
    model = ToxicityModel(features[keep], np.zeros(int(keep.sum())), -4.0)
    if not keep.any():
        return empty
    table = model.lookup()
    at, which, doc, offset = [], [], [], 0
    for s in tb.slices(column):
        w, sentence, row = _sentences(s)
        a, f = model.occurrences(w, sentence, table)
        at.append(a + offset)
        which.append(f)
        doc.append(row + s.lo)
        offset += len(row)
    at, which, doc = np.concatenate(at), np.concatenate(which), np.concatenate(doc)
    some = np.bincount(at, minlength=offset) > 0  # sentences with a feature
    m, v = np.zeros(len(model.weights) + 1), np.zeros(len(model.weights) + 1)
    chance = np.random.default_rng(7)
    for t in range(1, steps + 1):
        # a random half of the sentences each step, so that none leans on the others of its document;
        # then all of them, to set the bias
        whole = t > 0.7 * steps
        shown = some & (chance.random(offset) < (1.0 if whole else 0.5))
        p = shown * _sigmoid(model.bias + np.bincount(at, model.weights[which], minlength=offset))
        q = np.clip(_noisy_or(p, doc, len(y)), 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: p for a negative document, -p (1 - q) / q for a positive one
        g = p * np.where(y == 1, -(1 - q) / q, 1.0)[doc] / len(y)
        grad = np.concatenate((np.bincount(which, g[at], minlength=len(model.weights)) + shrink * model.weights, [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        model.weights -= 0 if whole else step[:-1]
        model.bias -= step[-1]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, most_rows: int = 8000, most_bytes: int = 24_000_000) -> ToxicityModel:
    """A model from the labelled rows of docs for which the condition learn on labels holds."""
    return train(*labelled_sample(docs, labels, label, learn, most_rows, most_bytes))


def _document_scores(model: ToxicityModel, table: np.ndarray, s: tb.Slice) -> tuple[np.ndarray, tuple]:
    """Scores of a slice's rows, and the words, sentence numbers, rows and scores of its sentences."""
    w, sentence, row = _sentences(s)
    p = model.sentence_scores(w, sentence, table)
    return np.where(np.diff(w.first) > 0, _noisy_or(p, row, s.hi - s.lo), 0.0), (w, sentence, row, p)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", offending: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), sentences.

    sentences: structs (start, end, score) of the sentences that score at least
    `offending`, in bytes of the UTF-8 text.  A null or empty text, or one
    without words, scores 0.  Only the text is read for a score, so repeated
    rows score alike.  An empty table has no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.lookup()
        for batch in batches:
            scores, where = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for s in tb.slices(batch.column(1)):
                scores[s.lo : s.hi], (w, sentence, row, p) = _document_scores(shared.value, table, s)
                for i in np.flatnonzero(p >= offending).tolist():
                    a, b = np.searchsorted(sentence, [i, i + 1])
                    base = s.bounds[row[i]]
                    where[s.lo + row[i]].append({"start": int(w.start[a] - base), "end": int(w.end[b - 1] - base), "score": float(p[i])})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(where, found)], names=["doc_id", "score", "sentences"])

    return texts(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def accepted(docs: DataFrame, model: ToxicityModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below `least`.

    Null, empty and wordless texts score 0 and stay; repeated rows stay or go
    together; an empty table stays empty.  Columns of any name pass unchanged:
    rows cross to Python once and are filtered there a slice at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        table = shared.value.lookup()
        for s in tb.slices(column):
            yield s.lo, s.hi, _document_scores(shared.value, table, s)[0] < least

    return filtered(docs, text, keep)
