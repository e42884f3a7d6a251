"""Alignment of two tokenizers by products of token-byte incidence matrices.

A text's tokens under a byte-level BPE (A) and a piece BPE (B) are rows of two
sparse matrices over the text's bytes.  Their product A Bt, row by row after
Gustavson, has an entry for each pair of tokens that share bytes.  Bytes where
tokens of both end cut the tokens into groups; products of the token-group
matrices link all tokens of one group.

Texts are first cut before each single space between two characters that are
not blank.  No token of A has a space within, and no piece of B has one after
another character (checked when it is loaded), so both end a token there, and
both encode what is between two cuts alike wherever it stands.  Hence tokens,
groups and links of a text are those of its segments, and a chunk of documents
aligns each distinct segment once.

The counts of linked pairs in all documents grow with them and are never
gathered.  A chunk sends one row for each of its distinct pairs, with the number
of its documents that hold it; sums come back to it by joins, so that a common
pair has as many rows as there are chunks, not as there are documents.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, texts

CUT = re.compile(r"(?<=\S) (?=\S)")
CHUNK_BYTES = 8 << 20  # text of a chunk, about
LEARNT_AT_ONCE = 1 << 17  # characters of short texts whose new segments are aligned together
PIECE = 1 << 20  # characters of a text that are cut into segments at once
EXPANDED_AT_ONCE = 1 << 17  # segments of documents whose pairs are laid out at once
SPACE = "▁"
TOTALS, SEGMENTS, DOCS = range(3)
OUT = "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, body binary, a int, b int, n long"


@dataclass
class Csr:
    """A sparse matrix by rows: row i has value[first[i]:first[i + 1]] in the columns column[first[i]:first[i + 1]]."""

    first: np.ndarray
    column: np.ndarray
    value: np.ndarray
    columns: int

    @classmethod
    def of_runs(cls, sizes: np.ndarray) -> Csr:
        """Row i has ones in the sizes[i] columns after those of the rows before it: tokens and their bytes."""
        first = np.concatenate(([0], np.cumsum(sizes)))
        return cls(first, np.arange(first[-1]), np.ones(first[-1], np.int64), int(first[-1]))

    @classmethod
    def of_labels(cls, label: np.ndarray, labels: int) -> Csr:
        """Row i has a one in the column label[i]: tokens and their groups."""
        return cls(np.arange(len(label) + 1), label, np.ones(len(label), np.int64), labels)

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        order = np.argsort(self.column, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(self.column, minlength=self.columns))))
        return Csr(first, row[order], self.value[order], len(self.first) - 1)

    def products(self, other: Csr) -> np.ndarray:
        """How many single products each row of self @ other adds up: the symbolic half of the multiplication."""
        sums = np.concatenate(([0], np.cumsum(np.diff(other.first)[self.column])))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def __matmul__(self, other: Csr) -> Csr:
        """Gustavson: for each entry of a row, the row of `other` in its column, scaled; equal columns are added up."""
        n = np.diff(other.first)[self.column]
        entry = np.repeat(np.arange(len(self.column)), n)
        at = other.first[self.column[entry]] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[entry]
        key, value = row * other.columns + other.column[at], self.value[entry] * other.value[at]
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        key, value = key[new], np.add.reduceat(value, new) if len(new) else value
        row, column = np.divmod(key, max(other.columns, 1))
        return Csr(np.searchsorted(row, np.arange(len(self.first))), column, value, other.columns)


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [x for x in range(256) if x not in plain]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space after another character; texts cannot be cut before spaces")

    def encode(self, text: str) -> list[np.ndarray]:
        """Ids under A of a space and the text, and under B, which adds the space itself."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return [np.array(ids, np.int64) for ids in (a, self.b.encode(text))]


@functools.lru_cache(maxsize=2)
def _pair(byte_bpe: str, piece_bpe: str) -> Pair:
    return Pair(byte_bpe, piece_bpe)


@dataclass
class Alignment:
    """Tokens, groups and links of some segments; a, b: ids; of_a, of_b: their segments; good: by segment, whether bytes agree."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    good: np.ndarray
    overlap: Csr  # A tokens by B tokens: shared bytes
    group_a: Csr  # A tokens by groups
    group_b: Csr


def _encoded(pair: Pair, segments: Sequence[str], rows: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(rows, ids, of) of some of the segments at a time: the ids of both sides, and the row of each.

    Segments without blanks at their ends are encoded as one text, which is cut
    where they are; where its bytes differ, its halves are tried, down to single
    segments.  Rows of segments whose own bytes differ are left out.
    """
    if not len(rows):
        return
    raw = [b" " + segments[i].encode() for i in rows.tolist()]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    whole = b"".join(raw)
    ids = pair.encode(whole[1:].decode())
    at = [np.cumsum(size[x]) for x, size in zip(ids, (pair.a_size, pair.b_size), strict=True)]
    if all(b"".join(map(token.__getitem__, x.tolist())) == whole and np.isin(ends, e).all() for x, e, token in zip(ids, at, (pair.a_bytes, pair.b_bytes), strict=True)):
        yield rows, ids, [rows[np.searchsorted(ends, e)] for e in at]
    elif len(rows) > 1:
        for half in np.array_split(rows, 2):
            yield from _encoded(pair, segments, half)


def align(pair: Pair, segments: Sequence[str]) -> Alignment:
    """Aligns each segment, with a space before it; one whose joined bytes differ has no tokens and is not good."""
    plain = np.fromiter((bool(s) and not s[0].isspace() and not s[-1].isspace() for s in segments), bool, len(segments))
    made = list(_encoded(pair, segments, np.flatnonzero(plain)))
    made += [x for i in np.flatnonzero(~plain) for x in _encoded(pair, segments, np.array([i]))]
    good = np.zeros(len(segments), bool)
    for rows, _, _ in made:
        good[rows] = True
    none = np.empty(0, np.int64)
    (a, of_a), (b, of_b) = ((np.concatenate([none, *(m[1][k] for m in made)]), np.concatenate([none, *(m[2][k] for m in made)])) for k in (0, 1))
    in_order = [np.argsort(of, kind="stable") for of in (of_a, of_b)]
    a, of_a, b, of_b = a[in_order[0]], of_a[in_order[0]], b[in_order[1]], of_b[in_order[1]]
    bytes_a, bytes_b = Csr.of_runs(pair.a_size[a]), Csr.of_runs(pair.b_size[b])
    ends = np.intersect1d(bytes_a.first[1:], bytes_b.first[1:])
    group_a, group_b = (Csr.of_labels(np.searchsorted(ends, x.first[1:]), len(ends)) for x in (bytes_a, bytes_b))
    return Alignment(a, b, of_a, of_b, good, bytes_a @ bytes_b.transposed(), group_a, group_b)


def _listed(x: Alignment, segments: int) -> list[bytes]:
    """Each segment's groups as `a1,a2|b1;a3|b2`: ids of both sides in order."""
    g = np.concatenate((x.group_a.column, x.group_b.column))
    side = np.repeat([0, 1], [len(x.a), len(x.b)])
    order = np.lexsort((side, g))  # stable, so tokens stay in order
    ids, of = np.concatenate((x.a, x.b))[order], np.concatenate((x.of_a, x.of_b))[order]
    g, side = g[order], side[order]
    last = np.concatenate((g[1:] != g[:-1], [True])) if len(g) else np.empty(0, bool)
    final = np.concatenate((of[1:] != of[:-1], [True])) if len(g) else last
    turn = np.concatenate((side[1:] != side[:-1], [True])) if len(g) else last
    mark = np.where(final, 0, np.where(last, 1, np.where(turn, 2, 3)))
    marks = ["", ";", "|", ","]
    words = [f"{i}{marks[m]}" for i, m in zip(ids.tolist(), mark.tolist(), strict=True)]
    bounds = np.searchsorted(of, np.arange(segments + 1)).tolist()
    return ["".join(words[p:q]).encode() for p, q in zip(bounds[:-1], bounds[1:], strict=True)]


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed: mostly small numbers shrink to little."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.array([len(x)], "<u4").tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Chunk:
    """Distinct segments of some documents with what each adds to a document, and the documents as lists of them."""

    def __init__(self, pair: Pair):
        self.pair, self.size = pair, 0
        self.index: dict[str, int] = {}
        self.good, self.listed, self.sums, self.pairs, self.times, self.n_pairs = [], [], [], [], [], []
        self.docs: list[tuple] = []

    def _learn(self, parts: list[str]) -> None:
        new = [p for p in dict.fromkeys(parts) if p not in self.index]
        if not new:
            return
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        x, n = align(self.pair, new), len(new)
        of_group = np.zeros(x.group_a.columns, np.int64)
        of_group[x.group_a.column] = x.of_a
        row = np.repeat(np.arange(len(x.a)), np.diff(x.overlap.first))
        shared = x.group_a.products(x.group_b.transposed())
        sums = [np.bincount(x.of_a, minlength=n), np.bincount(x.of_b, minlength=n), np.bincount(of_group, minlength=n), np.bincount(x.of_a[row], minlength=n), np.bincount(x.of_a, shared, n).astype(np.int64)]
        self.sums.append(np.array(sums).T)
        key = x.a[row] << 32 | x.b[x.overlap.column]
        order = np.lexsort((key, x.of_a[row]))
        key, of = key[order], x.of_a[row][order]
        new_pair = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))) if len(key) else np.empty(0, np.int64)
        self.pairs.append(key[new_pair])
        self.times.append(np.diff(np.concatenate((new_pair, [len(key)]))))
        self.n_pairs.append(np.bincount(of[new_pair], minlength=n))
        self.good += x.good.tolist()
        self.listed += _listed(x, n)

    def add_all(self, docs: list[tuple[int | None, str]]) -> None:
        cut = [CUT.split(text) if text and len(text) <= PIECE else [] for _, text in docs]
        self._learn([p for parts in cut for p in parts])
        for (doc_id, text), parts in zip(docs, cut, strict=True):
            self.add(doc_id, text, parts)

    def add(self, doc_id: int | None, text: str, parts: list[str] | None = None) -> None:
        """A document; parts has its segments where they are known already."""
        known, sha, found, at, good = parts, hashlib.sha256(), [], 0, bool(text)
        while good and at < len(text):
            cut = None if known else CUT.search(text, at + PIECE)
            parts = known or CUT.split(text[at : cut.start() if cut else len(text)])
            if not known:
                self._learn(parts)
            here = list(map(self.index.__getitem__, parts))
            sha.update(b";" * bool(found) + b";".join(map(self.listed.__getitem__, here)))
            found.append(np.array(here, np.int64))
            good = all(map(self.good.__getitem__, here))
            at = cut.end() if cut else len(text)
        self.size += len(text) + 256
        ids, times = np.unique(np.concatenate(found), return_counts=True) if good else (np.empty(0, np.int64),) * 2
        self.docs.append((doc_id, ids.astype(np.uint32), times.astype(np.uint32), sha.hexdigest() if good else ""))

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The chunk's rows: documents, its segments, and a row for each distinct pair."""
        sums = np.concatenate(self.sums or [np.zeros((0, 5), np.int64)])
        key, of_pair = np.unique(np.concatenate(self.pairs or [np.empty(0, np.int64)]), return_inverse=True)
        first = np.concatenate(([0], np.cumsum(np.concatenate(self.n_pairs or [np.empty(0, np.int64)]))))
        holds = np.zeros(len(key), np.int64)
        low = 0
        while low < len(self.docs):
            high, size = low, 0
            while high < len(self.docs) and (high == low or size < EXPANDED_AT_ONCE):
                size += len(self.docs[high][1])
                high += 1
            some = self.docs[low:high]
            n = np.array([len(d[1]) for d in some])
            ids, times = (np.concatenate([d[i] for d in some]).astype(np.int64) for i in (1, 2))
            doc = np.repeat(np.arange(len(some)), n)
            wide = (first[1:] - first[:-1])[ids]
            at = np.repeat(first[ids] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
            holds += np.bincount(np.unique(np.repeat(doc, wide) * max(len(key), 1) + of_pair[at]) % max(len(key), 1), minlength=len(key))
            total = [np.bincount(doc, times * sums[ids, c], len(some)).astype(np.int64) for c in range(5)]
            bodies = [_packed(np.concatenate((np.diff(d[1], prepend=np.uint32(0)), d[2]))) for d in some]
            yield self._batch(len(some), DOCS, chunk, doc_id=[d[0] for d in some], n_a=total[0], n_b=total[1], n_groups=total[2], n_links=total[3], n_group_links=total[4], groups_sha256=[d[3] for d in some], body=bodies)
            low = high
        body = _packed(np.concatenate(([len(first) - 1, len(of_pair)], np.diff(first, prepend=0), of_pair, *self.times)))
        yield self._batch(1, SEGMENTS, chunk, body=[body])
        for at in range(0, len(key), 1 << 16):
            some = key[at : at + (1 << 16)]
            yield self._batch(len(some), TOTALS, chunk, a=some >> 32, b=some & 0xFFFFFFFF, n=holds[at : at + (1 << 16)])

    @staticmethod
    def _batch(rows: int, kind: int, chunk: int, **columns) -> pa.RecordBatch:
        schema = _arrow_schema()
        columns |= {"kind": np.full(rows, kind), "chunk": np.full(rows, chunk)}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


@functools.cache
def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in OUT.split(", "))])


def _strings(column: pa.Array) -> Iterator[str]:
    for raw in column:
        yield (raw.as_py() or b"").decode("utf-8", "replace")  # what is not UTF-8 differs from both tokenizers' bytes


def _chunks(docs: DataFrame, byte_bpe: str, piece_bpe: str, chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _pair(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 32
        chunk, some, size = _Chunk(pair), [], 0
        gc.freeze()  # what is loaded holds no cycles to look for, however often lists of ids come and go
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _strings(batch.column(1)), strict=True):
                some.append((doc_id, text))
                size += len(text) + 256
                if size >= min(LEARNT_AT_ONCE, chunk_bytes):
                    chunk.add_all(some)
                    some, size = [], 0
                if chunk.size >= chunk_bytes:
                    yield from chunk.rows(number)
                    chunk, number = _Chunk(pair), number + 1
        chunk.add_all(some)
        if chunk.docs:
            yield from chunk.rows(number)

    return docs.mapInArrow(run, OUT)


def _scored(rows: DataFrame) -> DataFrame:
    """Documents with sums over their links, from the rows of each chunk: counts (n, negative where best) in order, segments, documents."""
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[np.ndarray] = []
        here, table = None, None
        for batch in batches:
            kind, chunk = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((kind[1:] != kind[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(kind)], strict=True) if len(kind) else ():
                part = batch.slice(low, high - low)
                if chunk[low] != here:
                    here, counts, table = chunk[low], [], None
                if kind[low] == TOTALS:
                    counts.append(part.column("n").to_numpy())
                elif kind[low] == SEGMENTS:
                    raw = _unpacked(part.column("body")[0].as_buffer())
                    segments, size = raw[:2].tolist()
                    first, of_pair, times = np.cumsum(raw[2 : segments + 3]), raw[segments + 3 : segments + 3 + size], raw[segments + 3 + size :]
                    n = np.concatenate(counts)[of_pair] if size else of_pair
                    sums = [np.concatenate(([0], np.cumsum(v))) for v in (times * (n < 0), times * np.abs(n))]
                    table = np.array([s[first[1:]] - s[first[:-1]] for s in sums])
                else:
                    body = [_unpacked(x.as_buffer()) for x in part.column("body")]
                    size = np.array([len(x) // 2 for x in body])
                    doc = np.repeat(np.arange(len(body)), size)
                    ids, times = (np.concatenate(v) for v in zip(*((np.cumsum(x[:m]), x[m:]) for x, m in zip(body, size.tolist(), strict=True)), strict=True))
                    added = np.zeros((2, len(body)), np.int64)
                    for c in range(2):
                        np.add.at(added[c], doc, table[c][ids] * times)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(added[0]), pa.array(added[1])], names=[*kept, "n_best", "count_sum"])

    ordered = rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "a", "b")
    return ordered.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, n_best long, count_sum long")


def aligned_counts(docs: DataFrame, byte_bpe: str, piece_bpe: str, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links.

    byte_bpe and piece_bpe are paths that every executor can open.  Links are
    pairs of a token of A and one of B, by place, that share bytes; the count of
    their pair of ids is the number of rows, repeated ones each for itself, that
    hold it linked; n_best counts links whose pair has the highest count of all
    with its id of A, ties included; count_sum adds up the counts of the links;
    n_group_links is the number of pairs of one group.  A null or empty text,
    one that a tokenizer changes and one that is not UTF-8 have no tokens: zeros
    and an empty groups_sha256.  A null doc_id stays null; an empty table gives
    an empty one; other columns are not read.
    """
    made = stored(_chunks(texts(docs, doc_id=doc_id, text=text), byte_bpe, piece_bpe, chunk_bytes), "alignment")
    pairs = made.where(F.col("kind") == TOTALS).select("chunk", "a", "b", "n")
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    signed = counts.join(best, "a").select("a", "b", F.when(F.col("n") == F.col("most"), -F.col("n")).otherwise(F.col("n")).alias("n"))
    back = pairs.drop("n").join(signed, ["a", "b"]).withColumn("kind", F.lit(TOTALS))
    others = made.where(F.col("kind") != TOTALS).drop("a", "b", "n")
    scored = _scored(back.unionByName(others, allowMissingColumns=True).select(*(c.split()[0] for c in OUT.split(", "))))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def token_links(docs: DataFrame, byte_bpe: str, piece_bpe: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per link: doc_id, a_index, b_index (places from 0), a_id, b_id, n_bytes that they share, group (from 0).

    Texts without tokens, as in aligned_counts, have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_bpe, piece_bpe)
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), _strings(batch.column(1)), strict=True):
                x = align(pair, CUT.split(value)) if value else None
                if x is None or not x.good.all():
                    continue
                row = np.repeat(np.arange(len(x.a)), np.diff(x.overlap.first))
                columns = (row, x.overlap.column, x.a[row], x.b[x.overlap.column], x.overlap.value, x.group_a.column[row])
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(row), pa.int64()), *map(pa.array, columns)], names=["doc_id", "a_index", "b_index", "a_id", "b_id", "n_bytes", "group"])

    return texts(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, a_index long, b_index long, a_id long, b_id long, n_bytes long, group long")
