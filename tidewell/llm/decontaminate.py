"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of `window` neighbouring words of a benchmark item is a pattern
(an item of fewer words is one pattern).  The alphabet of the search is the
hash of a word: a shift table over blocks of two words tells how far the
search may jump, the block at a pattern's end selects a bucket of patterns,
and what their hashes leave is compared word by word with the text.

The documents are never shuffled.  Executors cut the items into windows, join
equal ones and build the search tables, each of at most `table_bytes` of
patterns.  One table at a time is broadcast; a benchmark that needs several is
searched in as many passes, written in between, so that no more than one table
is ever held.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import filtered, stored, texts

SEGMENT = 64
MOST_SHIFT_BITS = 24  # of the shift table, one byte an entry


def _joined_words(s: tb.Slice, w: tb.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a slice parted by single blanks, and where each starts and ends there."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    at = np.flatnonzero(tb.ALNUM_WORDS[s.data])
    out[at + np.repeat(start - w.start, size)] = s.data[at]
    return out.tobytes(), start, start + size


class WuManber:
    """Search for patterns of one length: a matrix of word hashes, the words parted by blanks, and the items that hold each."""

    def __init__(self, patterns: np.ndarray, words: list[bytes], items: list[list[str]]):
        self.patterns, self.words, self.items = patterns, words, items
        count, self.length = patterns.shape
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        bits = min(max(12, int(np.ceil(np.log2(max(2, count * self.jump)))) + 2), MOST_SHIFT_BITS)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, min(self.jump, 255), dtype=np.uint8)  # a shorter jump than might be is safe
        for end in range(self.block, self.length + 1):
            np.minimum.at(self.shift, self._slot(self._blocks(patterns[:, end - self.block : end])), min(self.length - end, 255))
        suffix = self._blocks(patterns[:, self.length - self.block :])
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.by_suffix]

    def _blocks(self, columns: np.ndarray) -> np.ndarray:
        total = columns[:, 0] * tb.SHINGLE_CODES[0]
        for j in range(1, self.block):
            total = total + columns[:, j] * tb.SHINGLE_CODES[j]
        return tb.mix(total + np.uint64(self.block))

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks & self.mask).astype(np.int64)

    def find(self, s: tb.Slice, w: tb.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words of all occurrences in a slice with word hashes h, and the patterns' numbers."""
        at, pattern = self._by_hash(h, w.first)
        if not len(at):
            return at, pattern
        raw, start, end = _joined_words(s, w)
        spans = zip(start[at - self.length + 1].tolist(), end[at].tolist(), pattern.tolist(), strict=True)
        same = np.array([raw[a:b] == self.words[p] for a, b, p in spans], bool)
        return at[same], pattern[same]

    def _by_hash(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        lo, hi = first[:-1] + self.length - 1, first[1:]
        keep = hi > lo
        lo, hi = lo[keep], hi[keep]
        if not len(lo) or not len(self.patterns):
            return none, none
        pieces = (hi - lo + SEGMENT - 1) // SEGMENT
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(lo, pieces) + nth * SEGMENT
        end = np.minimum(at + SEGMENT, np.repeat(hi, pieces))
        blocks = tb.runs(h, self.block)  # blocks[i] starts at word i
        slots = self._slot(blocks)
        found = []
        while len(at):
            step = self.shift[slots[at - self.block + 1]].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            keep = at < end
            at, end = at[keep], end[keep]
        at = np.sort(np.concatenate(found))
        key = blocks[at - self.block + 1]
        left, right = np.searchsorted(self.suffixes, key, "left"), np.searchsorted(self.suffixes, key, "right")
        size = right - left
        at = np.repeat(at, size)
        pattern = self.by_suffix[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left, size)]
        for j in range(self.length):
            same = h[at - self.length + 1 + j] == self.patterns[pattern, j]
            at, pattern = at[same], pattern[same]
        return at, pattern


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Rows (size, words, hashes, item): the windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).cast(pa.string())
            for s in tb.slices(batch.column(1)):
                w = tb.words(s, tb.ALNUM_WORDS)
                h, (raw, start, end) = w.hashes(), _joined_words(s, w)
                for r, (a, b) in enumerate(itertools.pairwise(w.first.tolist())):
                    size = min(window, b - a)
                    n = b - a - size + 1 if size else 0
                    for low in range(a, a + n, 4096):
                        first = range(low, min(low + 4096, a + n))
                        words = [raw[start[i] : end[i + size - 1]] for i in first]
                        hashes = [h[i : i + size].tobytes() for i in first]
                        item = pa.array([names[s.lo + r].as_py()] * len(words), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), size, np.int32)), pa.array(words, pa.binary()), pa.array(hashes, pa.binary()), item], names=["size", "words", "hashes", "item"])

    return items.mapInArrow(run, "size int, words binary, hashes binary, item string")


def pattern_tables(items: DataFrame, window: int, table_bytes: int) -> DataFrame:
    """Rows (searches): lists of searches, a table of at most table_bytes of patterns each, built on the executors.

    A window's items are gathered, as a document that holds it must list them all.
    """
    grouped = _windows(items, window).groupBy("size", "words").agg(F.first("hashes").alias("hashes"), F.array_sort(F.collect_set("item")).alias("items"))
    grouped = stored(grouped, "windows")
    size = grouped.agg(F.sum(F.length("words") + F.length("hashes") + F.size("items") * 16)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        held = 0

        def table() -> pa.RecordBatch:
            searches = []
            for length, some in rows.items():
                words, hashes, owners = zip(*some, strict=True)
                searches.append(WuManber(np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, length), list(words), list(owners)))
            return pa.RecordBatch.from_pydict({"searches": pa.array([pickle.dumps(searches)], pa.binary())})

        for batch in batches:
            for length, words, hashes, owners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault(length, []).append((words, hashes, owners))
                held += len(words) + len(hashes) + 16 * len(owners)
                if held >= table_bytes:
                    yield table()
                    rows, held = {}, 0
        if rows:
            yield table()

    # dealt out in turn: as many tables as the bytes ask for, so as many passes, however finely keys are partitioned
    return stored(grouped.repartition(1 + int(size) // table_bytes).mapInArrow(run, "searches binary"), "patterns")


def _marked(s: tb.Slice, searches: list[WuManber]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set[str]]]]:
    """Words of each row of a slice, and of rows with hits: which words, and the items."""
    w = tb.words(s, tb.ALNUM_WORDS)
    h, found = w.hashes(), {}
    for search in searches:
        at, pattern = search.find(s, w, h)
        row = w.row[at]
        cuts = np.flatnonzero(np.diff(row)) + 1
        for ends, numbers in zip(np.split(at, cuts), np.split(pattern, cuts), strict=True):
            if len(ends):
                r = int(w.row[ends[0]])
                marks, items = found.setdefault(r, (np.zeros(w.first[r + 1] - w.first[r], bool), set()))
                for j in range(search.length):
                    marks[ends - w.first[r] - j] = True
                items.update(x for p in set(numbers.tolist()) for x in search.items[p])
    return np.diff(w.first), found


def _tables(benchmark: DataFrame, window: int, table_bytes: int, item_id: str, item_text: str) -> Iterator[tuple[bytes, bool]]:
    """Search tables, fetched one at a time, and whether each is the last; an empty one if there is no pattern."""
    rows = pattern_tables(texts(benchmark, doc_id=item_id, text=item_text), window, table_bytes).toLocalIterator()
    now = next(rows, None)
    if now is None:
        yield pickle.dumps([]), True
    while now is not None:
        after = next(rows, None)
        yield bytes(now.searches), after is None
        now = after


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    table_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items (sorted array), items_sha256, contaminated.

    Words are runs of digits, letters and non-ASCII characters after
    lower-casing A-Z.  A word is hit if it lies in an occurrence of a window.
    A null or empty text has no words; null or empty items hold no window.
    Windows of an item without id mark hits but are not listed.  Repeated rows
    are each reported; repeated items count once.  An empty benchmark hits
    nothing; empty documents give an empty result.
    """
    spark = docs.sparkSession
    out = texts(docs, F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"), doc_id=doc_id, text=text)
    between = out.schema
    result = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string"
    for table, last in _tables(benchmark, window, table_bytes, item_id, item_text):
        shared = spark.sparkContext.broadcast(table)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            searches = pickle.loads(shared.value)
            for batch in batches:
                hits, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                for s in tb.slices(batch.column(1)):
                    n_words[s.lo : s.hi], found = _marked(s, searches)
                    for r in range(s.lo, s.hi) if last else [s.lo + k for k in found]:
                        marks, more = found.get(r - s.lo, (None, ()))
                        if hits[r]:
                            before = np.unpackbits(np.frombuffer(hits[r], np.uint8), count=n_words[r]).astype(bool)
                            marks = before if marks is None else marks | before
                        if marks is not None:
                            items[r] = sorted({*items[r], *more})
                            hits[r], n_hit[r] = (None if last else np.packbits(marks).tobytes()), marks.sum()
                if last:
                    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "hits", "items"])

        out = out.mapInArrow(search, result if last else between)
        if not last:
            out = stored(out, "searched")
            shared.destroy()
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean_of_benchmarks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", table_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs.

    Null, empty and wordless texts hold none and stay; repeated rows stay or go
    together; with an empty benchmark all stay.  Columns of any name pass
    unchanged: rows cross to Python once and are filtered there.
    """
    items = benchmark.select(F.lit(None).cast("long").alias("item"), F.col(item_text).alias("words"))
    for table, last in _tables(items, window, table_bytes, "item", "words"):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def keep(column: pa.Array, shared=shared) -> Iterator[tuple[int, int, np.ndarray]]:
            searches = pickle.loads(shared.value)
            for s in tb.slices(column):
                clean = np.ones(s.hi - s.lo, bool)
                clean[list(_marked(s, searches)[1])] = False
                yield s.lo, s.hi, clean

        docs = filtered(docs, text, keep)
        if not last:
            docs = stored(docs, "searched")
            shared.destroy()
    return docs
