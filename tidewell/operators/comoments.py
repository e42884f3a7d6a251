"""Correlations of all pairs of factors by mergeable co-moment matrices.

Values arrive by date.  A task lays out some hundred cells of a date as a
matrix of instruments by factors and has, from four matrix products, the
counts, sums, squares and cross products of every pair over the cells that
both have.  These become means and co-moments, which add up over the parts of a
date without loss of digits.  What crosses a shuffle is a row for each value
and one for each part of a date, however many pairs of factors there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS_AT_ONCE = 1 << 20  # instruments times factors in one matrix
PART_ROWS = 1 << 21  # values of a date that one task takes
#: Of n * deviation^2, what is taken for rounding of a pair whose values are all the same.
NO_VARIATION = 1e-13
#: Of a factor's largest value, what is taken for rounding between the means of two parts.
NO_DIFFERENCE = 4e-15


@dataclass
class CoMoments:
    """K by K matrices over the cells that both factors of a pair have: count, mean and squares of the row's factor, co-moment; and the factors' largest sizes."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    cross: np.ndarray
    level: np.ndarray

    @classmethod
    def none(cls, k: int) -> CoMoments:
        return cls(*(np.zeros((k, k)) for _ in range(4)), np.zeros(k))

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """From a matrix of cells by factors, NaN where there is no value."""
        there = ~np.isnan(x)
        centre = np.divide(np.nansum(x, axis=0), there.sum(axis=0), out=np.zeros(x.shape[1]), where=there.any(axis=0))
        level = np.abs(np.where(there, x, 0.0)).max(axis=0, initial=0.0)
        x, m = np.where(there, x - centre, 0.0), there.astype(np.float64)
        n, total, square, cross = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
        exact = square - mean * total
        exact[exact <= NO_VARIATION * square] = 0.0
        return cls(n, mean + centre[:, None], exact, cross - mean * total.T, level)

    def __add__(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        level = np.maximum(self.level, other.level)
        apart[np.abs(apart) <= NO_DIFFERENCE * level[:, None]] = 0.0
        between = self.n * share
        mean = np.where(self.n > 0, self.mean + apart * share, other.mean)
        return CoMoments(n, mean, self.square + other.square + between * apart * apart, self.cross + other.cross + between * apart * apart.T, level)

    def correlations(self) -> np.ndarray:
        """K by K, NaN where a side does not vary over the cells of the pair."""
        scale = np.sqrt(self.square * self.square.T)
        return np.divide(self.cross, scale, out=np.full_like(scale, np.nan), where=scale > 0)

    def packed(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.n, self.mean, self.square, self.cross, self.level)]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, k: int) -> CoMoments:
        every = np.frombuffer(raw)
        return cls(*every[: 4 * k * k].reshape(4, k, k), every[4 * k * k :])


def _dates(long: DataFrame, names: Sequence[str], parts: int) -> DataFrame:
    """Rows (datetime, moments): the co-moments of each part of a date."""
    k = len(names)
    code = F.array_position(F.array(*map(F.lit, names)), F.col("factor")) - 1
    rows = long.select("datetime", F.pmod(F.xxhash64("instrument"), F.lit(parts)).alias("part"), "instrument", code.alias("code"), F.col("value").cast("double").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(CELLS_AT_ONCE // k, 64)
        rest: pa.Table | None = None

        def date(t: pa.Table) -> pa.RecordBatch:
            instrument = t.column("instrument").to_numpy(zero_copy_only=False).astype(str)
            cell = np.concatenate(([0], np.cumsum(instrument[1:] != instrument[:-1])))
            at, value = t.column("code").to_numpy(), t.column("value").to_numpy()
            total = CoMoments.none(k)
            for low in range(0, int(cell[-1]) + 1, at_once):
                mine = slice(*np.searchsorted(cell, [low, low + at_once]))
                x = np.full((int(cell[mine][-1]) - low + 1, k), np.nan)
                x[cell[mine] - low, at[mine]] = value[mine]
                total += CoMoments.of(x)
            return pa.RecordBatch.from_arrays([t.column("datetime").combine_chunks()[:1], pa.array([total.packed()], pa.binary())], names=["datetime", "moments"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
            days, part = rest.column("datetime").to_numpy(), rest.column("part").to_numpy()
            edges = [0, *(np.flatnonzero((days[1:] != days[:-1]) | (part[1:] != part[:-1])) + 1).tolist()]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                yield date(rest.slice(low, high - low))
            rest = rest.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield date(rest)

    kind = long.schema["datetime"].dataType.simpleString()
    return rows.repartition("datetime", "part").sortWithinPartitions("datetime", "part", "instrument").mapInArrow(run, f"datetime {kind}, moments binary")


def factor_correlations(long: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """f, g, mean_corr, mean_abs_corr and max_abs_corr of daily correlations over pairs f < g of factors that share a cell.

    From rows (datetime, instrument, factor, value); null values and those that
    are not finite do not count; a correlation is null where a side does not
    vary.  The names of the factors, as many as one side of the result, are all
    that the driver sees.  A date with more than part_rows values is dealt out
    by instrument.  Of rows that repeat a cell and a factor, one counts.
    """
    spark = long.sparkSession
    rows = long.where("value is not null and not isnan(value) and abs(value) != double('infinity') and factor is not null")
    names = sorted(r.factor for r in rows.select("factor").distinct().collect())
    if not names:
        return spark.createDataFrame([], "f string, g string, mean_corr double, mean_abs_corr double, max_abs_corr double")
    k = len(names)
    largest = rows.groupBy("datetime").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    per_part = _dates(rows, names, -(-largest // part_rows))

    def whole(parts: pa.Table) -> pa.Table:
        total = CoMoments.none(k)
        for raw in parts.column("moments"):
            total += CoMoments.unpacked(raw.as_py(), k)
        return pa.table({"met": pa.array([(total.n > 0).tobytes()], pa.binary()), "r": pa.array([total.correlations().tobytes()], pa.binary())})

    daily = per_part.groupBy("datetime").applyInArrow(whole, "met binary, r binary")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, n, total, size, most = np.zeros((k, k), bool), *(np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                met |= np.frombuffer(a.as_py(), bool).reshape(k, k)
                r = np.frombuffer(b.as_py()).reshape(k, k)
                there = ~np.isnan(r)
                r = np.where(there, r, 0.0)
                n, total, size, most = n + there, total + r, size + np.abs(r), np.maximum(most, np.abs(r))
        f, g = np.nonzero(np.triu(met, 1))
        columns = [f, g, n[f, g].astype(np.int64), total[f, g], size[f, g], most[f, g]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["f", "g", "n", "total", "size", "most"])

    summed = daily.mapInArrow(sums, "f long, g long, n long, total double, size double, most double").groupBy("f", "g").agg(*(F.sum(c).alias(c) for c in ("n", "total", "size")), F.max("most").alias("most"))
    name = F.array(*map(F.lit, names))
    some = F.col("n") > 0
    return summed.select(
        F.get(name, F.col("f").cast("int")).alias("f"),
        F.get(name, F.col("g").cast("int")).alias("g"),
        F.when(some, F.col("total") / F.col("n")).alias("mean_corr"),
        F.when(some, F.col("size") / F.col("n")).alias("mean_abs_corr"),
        F.when(some, F.col("most")).alias("max_abs_corr"),
    )
