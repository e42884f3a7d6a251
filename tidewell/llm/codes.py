"""Vector code compression: product codes of integer vectors by exact matrix products.

Components become whole numbers floor(scale * x); a vector is cut into equal
parts, and each part is coded by the nearest of a few codebook entries.  All
distances are exact: |x|^2 - 2 x.c + |c|^2 in 64-bit integers, where the dot
products come from float64 matrix products of limbs.  A limb has so few bits
that a sum of limb products stays below 2^53 and is exact; limbs are put
together by shifts in 64-bit integers.

Codebooks are trained in rounds over all rows: tasks add up the parts that fall
to each entry, Spark adds up the tasks' sums, and the driver gets one number for
each component of the codebooks, whose size does not depend on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spare, stored

ROWS_AT_ONCE = 8192
EXACT_BITS = 53  # whole numbers below 2^53 are exact in float64


def limb_bits(terms: int) -> int:
    """Bits of a limb such that a sum of that many products of two limbs is below 2^53."""
    return (EXACT_BITS - terms.bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x as a sum of limb << bits * place; all but the last limb are not negative, and none reaches 2^bits in size."""
    out = []
    while (np.abs(x) >> bits).any():
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, c: np.ndarray, bits: int | None = None) -> np.ndarray:
    """x @ c.T of 64-bit integers, exact wherever the result fits 64 bits."""
    bits = bits or limb_bits(x.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    others = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(others):
            out += (a @ b.T).astype(np.int64) << bits * (i + j)  # wraps modulo 2^64, as the sum does
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors), rows by parts: of x (n, parts * size), the first nearest entry of each part's book (parts, entries, size) and its squared distance."""
    n, (parts, _, size) = len(x), books.shape
    code, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        own = x[:, p * size : (p + 1) * size]
        d = (own * own).sum(axis=1)[:, None] - 2 * exact_products(own, books[p]) + (books[p] * books[p]).sum(axis=1)
        code[:, p] = d.argmin(axis=1)
        error[:, p] = d[np.arange(n), code[:, p]]
    return code, error


def _whole(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """(length, whole numbers) of each vector; None for one that is null or holds null or non-finite components."""
    for one in column:
        values = one.values if one.is_valid else None
        if values is None or values.null_count:
            yield 0, None
            continue
        x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if not np.isfinite(x).all():
            yield 0, None
            continue
        if len(x) * (2 * np.abs(x).max(initial=0)) ** 2 >= 2.0**63:
            raise ArithmeticError("a component is so large that squared distances exceed 64 bits")
        yield len(x), x.astype(np.int64)


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """The rows (vec_id, vector, label) whose vector is whole and finite, as vec_id, label, dims, x; x has little-endian 32-bit integers, or 64-bit ones where they need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, x, good = [], [], []
            for n, v in _whole(batch.column(1), scale):
                good.append(v is not None)
                if v is not None:
                    dims.append(n)
                    x.append(v.astype("<i4" if np.abs(v).max(initial=0) < 1 << 31 else "<i8").tobytes())
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), pa.array(dims, pa.int32()), pa.array(x, pa.binary())], names=["vec_id", "label", "dims", "x"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, dims int, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    raw = [x.as_buffer() for x in column]
    narrow = [len(x) == 4 * dims for x in raw]
    if all(narrow):
        return np.frombuffer(b"".join(raw), "<i4").reshape(-1, dims).astype(np.int64)
    return np.array([np.frombuffer(x, "<i4" if small else "<i8") for x, small in zip(raw, narrow, strict=True)], np.int64)


def _first_books(kept: DataFrame, dims: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids, ascending; of rows that repeat an id, the one of the least bytes."""
    ids = [r.vec_id for r in kept.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    found = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect() if ids else []
    x = _matrix(pa.array([bytes(r.x) for r in found], pa.binary()), dims) if found else np.empty((0, dims), np.int64)
    return x.reshape(len(x), parts, dims // parts).transpose(1, 0, 2)


def _next_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of the parts nearest to it; entries without parts stay."""
    parts, entries, size = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = _matrix(batch.column(0).slice(at, ROWS_AT_ONCE), parts * size)
                slot = (nearest(x, shared.value)[0] + np.arange(parts) * entries).ravel()
                order = np.argsort(slot, kind="stable")
                used, first = np.unique(slot[order], return_index=True)
                sums[used] += np.add.reduceat(x.reshape(-1, size)[order], first, axis=0)
                n += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, size)), pa.array(np.tile(np.arange(size), len(used))), pa.array(sums[used].ravel()), pa.array(np.repeat(n[used], size))], names=["slot", "place", "total", "n"])

    totals = kept.select("x").mapInArrow(run, "slot long, place long, total long, n long")
    summed = totals.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    flat = out.reshape(-1, size)
    for r in summed.collect():  # a row for each component of the codebooks
        flat[r.slot, r.place] = int(r.total) // r.n
    return out


def train(kept: DataFrame, dims: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks (parts, entries, size) of the rows that whole_vectors gives, all of `dims` components."""
    books = _first_books(kept, dims, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = _next_books(kept, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    parts, entries, size = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = entries and np.array([d == parts * size for d in batch.column(2).to_pylist()], bool)
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            rows = np.flatnonzero(fits)
            for at in range(0, len(rows), ROWS_AT_ONCE):
                some = rows[at : at + ROWS_AT_ONCE]
                codes, errors = nearest(_matrix(batch.column(3).take(pa.array(some)), parts * size), shared.value)
                for i, c, e in zip(some.tolist(), codes.astype(np.uint8), errors.sum(axis=1).tolist(), strict=True):
                    code[i], error[i] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compressed(
    vectors: DataFrame,
    scale: int = 4096,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per vector that is not null and has no null or non-finite component: vec_id, code, error, label_error, codebooks_sha256.

    Codebooks start as the parts of the vectors of the `entries` smallest ids
    (fewer, if there are fewer) and are trained in `rounds` rounds; ties go to
    the lower index; entries that nothing falls to stay.  code has two hex
    digits a part, error is the squared distance, label_error its sum over the
    rows of the label, rows with a null label together, codebooks_sha256 the
    hash of all final entries.  Repeated rows are coded each for itself and
    weigh in the means; a repeated id starts one entry only.  Vectors whose
    length is not the most frequent one that is a multiple of `parts` (of equally
    frequent ones, the longest) are not coded: null code and error.  Rows with
    a null id are coded, but start no entry.  An empty table gives an empty one;
    other columns are not read.  Components beyond what 64-bit squared distances
    allow raise an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    kept = stored(whole_vectors(rows, scale), "whole-vectors")
    lengths = kept.where(f"dims > 0 and dims % {parts} = 0").groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    dims = lengths[0].dims if lengths else parts
    books = train(kept.where(F.col("dims") == dims), dims, parts, entries, rounds)
    coded = stored(_coded(kept, books), "codes")
    other = spare(coded, "of_label")[0]
    sums = coded.groupBy(F.col("label").alias(other)).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col(other)))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
