"""Vectorised word and hash helpers over Arrow batches of UTF-8 texts.

All functions work on whole batches of raw bytes with numpy, so a task needs
no per-character Python.  A text is cut into words by a 256-entry table of
word bytes; bytes of 0x80 and above always belong to words, which makes the
cut on bytes the same as the cut on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# Separators of the two word definitions, as byte values.
SPACE_LIKE = [0x20, *range(0x09, 0x0E)]
NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


def word_table(separators: list[int]) -> np.ndarray:
    """256 booleans: True where a byte is part of a word."""
    table = np.ones(256, dtype=bool)
    table[separators] = False
    return table


SPACE_WORDS = word_table(SPACE_LIKE)
ALNUM_WORDS = word_table(NOT_ALNUM)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240611)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)
SHINGLE_CODES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        step = np.full(size, _BASE, dtype=np.uint64)
        back = np.full(size, _BASE_INVERSE, dtype=np.uint64)
        step[0] = back[0] = 1
        _powers, _inverses = np.cumprod(step), np.cumprod(back)
    return _powers[:n], _inverses[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Slice:
    """Some consecutive rows of a batch: row numbers lo to hi and their bytes."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


@dataclass
class Words:
    """Words of a slice in text order: byte ranges, row within the slice, first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    sums: np.ndarray | None = None
    inverses: np.ndarray | None = None

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first `prefix` bytes."""
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        return mix((self.sums[end] - self.sums[self.start]) * self.inverses[self.start])


def slices(column: pa.Array, lower: bool = True) -> Iterator[Slice]:
    """Cuts a binary (or string) column into slices of about SLICE_BYTES; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        part = data[offsets[lo] : offsets[hi]]
        yield Slice(lo, hi, LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def words(s: Slice, table: np.ndarray, hashed: bool = True) -> Words:
    """The words of every row of a slice; words never span two rows."""
    inside = table[s.data]
    n = len(inside)
    edges = s.bounds[:-1][s.bounds[:-1] < n]
    opens = inside.copy()
    closes = inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        opens[edges] = inside[edges]
        closes[:-1] &= ~inside[1:]
        last = edges[edges > 0] - 1
        closes[last] = inside[last]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, s.bounds)
    row = np.repeat(np.arange(len(s.bounds) - 1), np.diff(first))
    out = Words(start, end, row, first)
    if hashed:
        powers, out.inverses = _power_tables(n + 1)
        out.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[s.data] * powers[:n], out=out.sums[1:])
    return out


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbouring entries of h (len(h) - width + 1 of them)."""
    total = h[: len(h) - width + 1] * SHINGLE_CODES[0]
    for j in range(1, width):
        total = total + h[j : len(h) - width + 1 + j] * SHINGLE_CODES[j]
    return mix(total + np.uint64(width))


def shingle_sets(s: Slice, width: int = 5, table: np.ndarray = SPACE_WORDS) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles.

    A row of fewer words than `width` has one shingle, its whole sequence; a
    row without words has none.
    """
    w = words(s, table)
    h = w.hashes()
    whole = runs(h, width) if len(h) >= width else np.empty(0, np.uint64)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(whole[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(runs(h[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
