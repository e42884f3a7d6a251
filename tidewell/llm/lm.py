"""Language-model scoring by cross-entropy difference.

Two bigram models over one vocabulary: a target model of the documents that a
label marks, a background model of all documents.  The vocabulary is every word
of all documents and one unseen word; every bigram counts, those that occur once
too.  In both models the chance of a word r after a word l is

    weight * count(l, r) / followed(l) + (1 - weight) * chance of r,

where followed(l) is how often l has a word after it, and the chance of r alone
is (count(r) + 1) / (words + vocabulary).  The counts after l add up to
followed(l), so that chances after each word add up to 1, and the models are
matched in everything but their counts.  At the start of a document, and after a
word that the model never saw followed, it is the chance of r alone.  A
document's score is its mean loss per word under the background less that under
the target.

The models grow with the documents and are never gathered in one place.
Documents are dealt into chunks of bounded size; words and bigrams, by their
hashes, into buckets whose number follows the bytes of the texts.  A chunk
sends each bucket its distinct keys with counts, and the bucket sends back, in
the same order, the counts in all documents.  So a key has one entry a chunk at
most, however common it is, and a chunk has just the part of the models that
its own documents need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import stored, texts

CHUNK_WORDS = 700_000
BUCKET_BYTES = 4 << 20
UNSEEN = 0  # hash of the unseen word; every chunk has it as its first word

DOCS, CHOSEN, WORDS, BIGRAMS, TOTALS = range(5)
MESSAGE = ("kind", "chunk", "bucket", "a", "b", "c")
SCHEMA = "kind int, chunk long, bucket long, a binary, b binary, c binary"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, as many as the largest needs, compressed: planes of mostly small numbers shrink to little."""
    planes = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return np.array([planes, len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    if not len(raw):
        return np.empty(0, np.int64)
    planes, size = np.frombuffer(raw[:16], "<i8").tolist()
    data = np.frombuffer(pa.decompress(raw[16:], size, "zstd"), np.uint8).reshape(planes, -1) if size else np.empty((planes, 0), np.uint8)
    out = np.zeros((data.shape[1], 8), np.uint8)
    out[:, :planes] = data.T
    return out.view("<i8").ravel()


def _packed_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes, one at least, by their differences."""
    return h[:1].tobytes() + _packed(np.diff(h))


def _unpacked_sorted(raw: pa.Buffer) -> np.ndarray:
    if not len(raw):
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(raw[:8], np.uint64), _unpacked(raw[8:]).view(np.uint64))), dtype=np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(MESSAGE))


def _cuts(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, low, high) of the buckets of sorted hashes; buckets ascend with the hashes."""
    of = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))).tolist() if len(of) else [0]
    return [(int(of[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _by(df: DataFrame, key: str, one: Callable[[list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies `one` to the messages of each key, by kind, then bucket, then chunk."""
    at = MESSAGE.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            whole = [batch.column(i).to_pylist() for i in range(3)]
            parts = [batch.column(i) for i in range(3, 6)]
            for i, head in enumerate(zip(*whole, strict=True)):
                if rows and rows[-1][at] != head[at]:
                    yield from one(rows)
                    rows = []
                rows.append((*head, *(p[i].as_buffer() for p in parts)))
        if rows:
            yield from one(rows)

    order = dict.fromkeys((key, "kind", "bucket", "chunk"))
    return df.select(*MESSAGE).repartition(key).sortWithinPartitions(*order).mapInArrow(run, schema)


def _lists(rows: list[tuple], kind: int, at: int) -> np.ndarray:
    """Counts in the order of the keys; of words a second list, of those at the ends of documents."""
    of = 2 if kind == WORDS else 1
    return np.concatenate([np.empty((of, 0), np.int64), *(_unpacked(r[at]).reshape(of, -1) for r in rows if r[0] == kind)], axis=1)


def _hashes(raw: pa.Buffer) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _chunks_of(docs: DataFrame) -> DataFrame:
    """Chunks of documents (DOCS): their ids and lengths, their words by descending counts, and the texts as places in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, heads, size, made = [], [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            words, ids, n = np.unique(np.concatenate(([np.uint64(UNSEEN)], *hashes)), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # common words get small numbers
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            return _batch([(DOCS, task + made, -1, np.concatenate(heads, axis=1).tobytes(), words[order].tobytes(), _packed(place[ids[1:]]))])

        for batch in batches:
            valid = np.asarray(batch.column(0).is_valid())
            doc_id = batch.column(0).fill_null(0).to_numpy()
            for s in tb.slices(batch.column(1)):
                w = tb.words(s, tb.ALNUM_WORDS)
                hashes.append(w.hashes())
                heads.append(np.array([doc_id[s.lo : s.hi], valid[s.lo : s.hi], np.diff(w.first)], np.int64))
                size += len(hashes[-1]) + s.hi - s.lo
                if size >= CHUNK_WORDS:
                    yield flush()
                    hashes, heads, size, made = [], [], 0, made + 1
        if heads:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _chosen(chunks: DataFrame, target_ids: DataFrame) -> DataFrame:
    """CHOSEN messages: to each chunk the places of its documents of the target, as numbers parted by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_id, valid, _ = np.frombuffer(raw, np.int64).reshape(3, -1)
                at = np.flatnonzero(valid)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(doc_id[at]), pa.array(at)], names=["chunk", "doc_id", "at"])

    ids = chunks.select("chunk", "a").mapInArrow(run, "chunk long, doc_id long, at long")
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # the target's ids grow with the documents, so they are never broadcast; ids alone are shuffled
    found = ids.join(wanted.hint("merge"), "doc_id").groupBy("chunk").agg(F.array_join(F.collect_list("at"), ",").cast("binary").alias("a"))
    none = F.lit(None).cast("binary")
    return found.select(F.lit(CHOSEN).alias("kind"), "chunk", F.lit(-1).cast("long").alias("bucket"), "a", none.alias("b"), none.alias("c"))


class Chunk:
    """Documents of a chunk, its words, and its distinct bigrams by hash."""

    def __init__(self, rows: list[tuple]):
        docs = next(r for r in rows if r[0] == DOCS)
        self.name = docs[1]
        self.doc_id, self.valid, self.length = np.frombuffer(docs[3], np.int64).reshape(3, -1)
        self.chosen = np.zeros(len(self.length))
        for r in rows:
            if r[0] == CHOSEN:
                self.chosen[np.array(r[3].to_pybytes().split(b","), np.int64)] = 1
        words = _hashes(docs[4])
        by_hash = np.argsort(words)
        sorted_at = np.empty(len(words), np.int64)
        sorted_at[by_hash] = np.arange(len(words))
        self.words, self.ids = words[by_hash], sorted_at[_unpacked(docs[5])]
        self.row = np.repeat(np.arange(len(self.length)), self.length)
        self.inside = self.row[1:] == self.row[:-1]
        pair, at = np.unique((self.ids[:-1] * len(self.words) + self.ids[1:])[self.inside], return_inverse=True)
        left, right = pair // len(self.words), pair % len(self.words)
        key = tb.mix(self.words[left] * tb.SHINGLE_CODES[0] + self.words[right] * tb.SHINGLE_CODES[1])
        order = np.argsort(key, kind="stable")
        self.key, self.left, self.right = key[order], left[order], right[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at = place[at]  # the bigram of each word that is not the first of its document


def _send(buckets: int) -> Callable[[list[tuple]], Iterator[pa.RecordBatch]]:
    """Of a chunk: to the buckets its words and bigrams, with their counts in it and in its documents of the target; of words then those at the ends of documents."""

    def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        c = Chunk(rows)
        of_word, of_bigram = c.chosen[c.row], c.chosen[c.row[1:][c.inside]]
        final = np.append(~c.inside, True) if len(c.ids) else np.zeros(0, bool)
        for kind, key, lists in ((WORDS, c.words, ((c.ids, of_word), (c.ids[final], of_word[final]))), (BIGRAMS, c.key, ((c.at, of_bigram),))):
            n = np.array([np.bincount(at, minlength=len(key)) for at, _ in lists])
            target = np.array([np.bincount(at, of, minlength=len(key)) for at, of in lists])
            if out := [(kind, c.name, k, _packed_sorted(key[a:b]), _packed(n[:, a:b].ravel()), _packed(target[:, a:b].ravel())) for k, a, b in _cuts(key, buckets)]:
                yield _batch(out)

    return one


def _count(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Of a bucket: to each chunk the counts of its words and bigrams in all documents and in the target, and the bucket's totals of words."""
    for kind in (WORDS, BIGRAMS):
        if not (sent := [r for r in rows if r[0] == kind]):
            continue
        key = [_unpacked_sorted(r[3]) for r in sent]
        keys, at = np.unique(np.concatenate(key), return_inverse=True)
        n, target = ([np.bincount(at, x, minlength=len(keys)).astype(np.int64) for x in _lists(sent, kind, i)] for i in (4, 5))
        out, low = [], 0
        if kind == WORDS:
            out.append((TOTALS, -1, sent[0][2], np.array([n[0].sum(), target[0].sum(), (n[0] > 0).sum()], np.int64).tobytes(), b"", b""))
        for r, k in zip(sent, key, strict=True):
            mine = at[low : (low := low + len(k))]
            out.append((kind, r[1], r[2], *(_packed(np.concatenate([x[mine] for x in of])) for of in (n, target)), b""))
        yield _batch(out)


def _score(totals: np.ndarray, weight: float) -> Callable[[list[tuple]], Iterator[pa.RecordBatch]]:
    every, every_target, known = totals.tolist()
    v = known + 1

    def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        c = Chunk(rows)
        begins = np.append(True, ~c.inside) if len(c.ids) else np.zeros(0, bool)
        losses = []
        for total, field in ((every_target, 4), (every, 3)):
            n, ends = _lists(rows, WORDS, field)
            unigram = (n + 1) / (total + v)
            followed = (n - ends)[c.left]
            after = _lists(rows, BIGRAMS, field)[0] / np.maximum(followed, 1)
            chance = np.where(followed > 0, weight * after + (1 - weight) * unigram[c.right], unigram[c.right])
            loss = np.empty(len(c.ids))
            loss[begins] = -np.log(unigram[c.ids[begins]])
            loss[~begins] = -np.log(chance)[c.at]
            losses.append(np.bincount(c.row, loss, minlength=len(c.length)))
        target, background = losses
        columns = [pa.array(c.doc_id, mask=c.valid == 0), pa.array(c.length), pa.array(target), pa.array(background), pa.array((background - target) / np.maximum(c.length, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return one


def cross_entropy_difference(
    docs: DataFrame,
    target_ids: DataFrame,
    weight: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, target_loss, background_loss, score.

    target_ids has the doc_ids of the target corpus in its column doc_id;
    repeated and null ones change nothing.  Losses are nats in all; score is
    (background_loss - target_loss) / n_words, higher where the text is closer
    to the target, and 0 for null, empty or wordless texts.  With no target or
    an empty vocabulary the models are uniform and every score is finite.  Equal
    texts have equal losses, whatever their ids; ties need no order.
    """
    read = texts(docs, doc_id=doc_id, text=text)
    size = read.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunks = stored(_chunks_of(read), "chunks")
    asked = _by(chunks.unionByName(_chosen(chunks, target_ids)), "chunk", _send(1 + size // BUCKET_BYTES), SCHEMA)
    counted = stored(_by(asked, "bucket", _count, SCHEMA), "counts", partition_by="kind").select(*MESSAGE)
    totals = np.zeros(3, np.int64)
    for r in counted.where(f"kind = {TOTALS}").select("a").toLocalIterator():  # three numbers a bucket
        totals += np.frombuffer(r.a, np.int64)
    whole = chunks.unionByName(counted.where(f"kind <> {TOTALS}"))
    return _by(whole, "chunk", _score(totals, weight), "doc_id long, n_words long, target_loss double, background_loss double, score double")
