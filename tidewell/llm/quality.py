"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are the shapes of blank-separated chunks (classes of neighbouring
characters, runs collapsed), whether a word repeats one of the two before it,
and hashed words.  A bounded sample of labelled documents gives the term
weights, the latent space (truncated SVD) and the vectors that vote.  These are
broadcast; every document then gets exact cosines with all of them, in blocks,
and its nearest neighbours vote with their similarities as weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import texts
from .toxicity import labelled_sample

SHAPES, WORDS = 512, 512
TERMS = SHAPES + WORDS + 3

# Classes of characters for shapes: lower case, upper case, digits and non-ASCII collapse to one each.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")


def term_matrix(s: tb.Slice) -> np.ndarray:
    """Terms by document of a slice (raw bytes): log counts, each group scaled to the document's length."""
    rows = s.hi - s.lo
    chunk = tb.words(s, tb.SPACE_WORDS)
    low = tb.Slice(s.lo, s.hi, tb.LOWER[s.data], s.bounds)
    word = tb.words(low, tb.SPACE_WORDS).hashes()
    kinds = _CLASS[s.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[chunk.start] = True
    moved = np.concatenate(([0], np.cumsum(keep)))
    short = tb.Slice(s.lo, s.hi, kinds[keep], moved[s.bounds])
    shape = tb.words(short, tb.SPACE_WORDS).hashes()
    out = np.zeros((rows, TERMS))
    flat = chunk.row * TERMS

    def add(columns: np.ndarray, at: np.ndarray = flat, width: int = TERMS) -> None:
        np.add(out, np.bincount(at + columns, minlength=rows * width).reshape(rows, width), out=out)

    add((shape % np.uint64(SHAPES)).astype(np.int64))
    add(SHAPES + (word % np.uint64(WORDS)).astype(np.int64))
    again = np.zeros(len(word), bool)
    for back in (1, 2):
        again[back:] |= (word[back:] == word[:-back]) & (chunk.row[back:] == chunk.row[:-back])
    add(SHAPES + WORDS + again)
    size = np.maximum(np.diff(chunk.first), 1)[:, None]
    out /= size
    out[:, -1] = np.log1p(np.diff(chunk.first)) / 20
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class QualityModel:
    mean: np.ndarray
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        return _unit((terms - self.mean) * self.weight @ self.basis)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest vectors; the prior where none is near."""
        if not len(self.vectors):
            return np.full(len(terms), self.prior)
        cosine = self.latent(terms) @ self.vectors.T
        k = min(self.neighbours, len(self.vectors))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 4
        total = vote.sum(axis=1)
        share = (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, share, self.prior), 0, 1)


def train(corpus: list[bytes], y: np.ndarray, rank: int = 24, neighbours: int = 11) -> QualityModel:
    """Term weights, latent basis and voting vectors of labelled texts; without any, every score is 0.5."""
    if not len(y):
        return QualityModel(np.zeros(TERMS), np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), y, neighbours, 0.5)
    terms = np.concatenate([term_matrix(s) for s in tb.slices(pa.array(corpus, pa.binary()), lower=False)])
    mean = terms.mean(axis=0)
    weight = np.log1p(len(terms) / (1 + (terms > 0).sum(axis=0)))
    weight[:SHAPES] *= 2
    weight[SHAPES : SHAPES + WORDS] *= 0.25
    weight[SHAPES + WORDS :] = 2.0
    x = (terms - mean) * weight
    values, basis = np.linalg.eigh(x.T @ x)
    basis = basis[:, ::-1][:, : min(rank, TERMS)]
    return QualityModel(mean, weight, basis, _unit(x @ basis), y, neighbours, float(y.mean()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, most_rows: int = 3000, most_bytes: int = 24_000_000, **options) -> QualityModel:
    """A model from at most most_rows labelled rows for which the condition learn on labels holds."""
    return train(*labelled_sample(docs, labels, label, learn, most_rows, most_bytes), **options)


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and score (0 to 1, higher: label 1 likelier).

    A null text is scored as an empty one, which gets the vote of its
    neighbours like any other.  Repeated rows score alike.  Of voters with one
    cosine at the edge of the nearest, any may vote, the same ones for the same
    text.  An empty table has no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(term_matrix(s)) for s in tb.slices(batch.column(1), lower=False)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    return texts(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, score double")
