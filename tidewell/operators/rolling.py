"""Rolling statistics over time blocks: order statistics of sliding windows and exponential means.

An instrument's rows are numbered over all tasks and cut into blocks of equal
length, so that one of any length is shared among tasks.  Order statistics want
the rows before a block that its first windows reach back to: these travel with
it, a halo of the longest window less one.  Exponential means are a linear
recurrence: each block gives the weighted sum and weight of its own rows, blocks
combine by a decay to the power of their length, and what comes before a block
is added to its rows.  A row is never held as a list of its past.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

BLOCK_ROWS = 4096
WINDOW_CELLS = 1 << 20  # rows times window length that are laid out at once
FARTHEST = 230.0  # powers of a decay are taken up to e^230 at once


@dataclass(frozen=True)
class Rolled:
    """A statistic of a column: its kind, the window's length in rows, and for a quantile or an exponential mean the share or weight."""

    kind: str
    column: str
    n: int = 1
    share: float = 0.0


def quantile(column: str, n: int, q: float) -> Rolled:
    """Interpolated; null unless all n values are there."""
    return Rolled("quantile", column, n, q)


def mad(column: str, n: int) -> Rolled:
    """Median distance from the median of the values that are there."""
    return Rolled("mad", column, n)


def rank(column: str, n: int) -> Rolled:
    """Average rank of the row's value in the full window, as a share of n."""
    return Rolled("rank", column, n)


def argmax(column: str, n: int) -> Rolled:
    """Place of the first largest value of a full window, 1 at its start."""
    return Rolled("argmax", column, n)


def argmin(column: str, n: int) -> Rolled:
    return Rolled("argmin", column, n)


def highday(column: str, n: int) -> Rolled:
    """How many values from the first largest one on, it included."""
    return Rolled("highday", column, n)


def lowday(column: str, n: int) -> Rolled:
    return Rolled("lowday", column, n)


def exponential(column: str, alpha: float) -> Rolled:
    """Mean of all values so far under weights (1 - alpha)^age, ages in rows."""
    return Rolled("exponential", column, 1, alpha)


def _middle(sorted_rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the first n entries of each sorted row; NaN for none."""
    at, row = np.maximum(n - 1, 0), np.arange(len(n))
    return np.where(n > 0, (sorted_rows[row, at // 2] + sorted_rows[row, (at + 1) // 2]) / 2, np.nan)


def _windowed(spec: Rolled, w: np.ndarray) -> np.ndarray:
    """The statistic of each row of windows w, oldest value first, NaN where there is none."""
    there = ~np.isnan(w)
    n = there.sum(axis=1)
    full = n == w.shape[1]
    if spec.kind == "quantile":
        place = spec.share * (spec.n - 1)
        low, high = math.floor(place), math.ceil(place)
        part = np.partition(w, [low, high], axis=1)
        return np.where(full, part[:, low] + (part[:, high] - part[:, low]) * (place - low), np.nan)
    if spec.kind == "mad":
        middle = _middle(np.sort(w, axis=1), n)
        return _middle(np.sort(np.abs(w - middle[:, None]), axis=1), n)
    if spec.kind == "rank":
        own = w[:, -1:]
        return np.where(full, ((w < own).sum(axis=1) + ((w == own).sum(axis=1) + 1) / 2) / spec.n, np.nan)
    least = spec.kind in ("argmin", "lowday")
    at = np.where(there, w, np.inf).argmin(axis=1) if least else np.where(there, w, -np.inf).argmax(axis=1)
    if spec.kind in ("argmax", "argmin"):
        return np.where(full, at + 1.0, np.nan)
    after = (there & (np.arange(w.shape[1]) >= at[:, None])).sum(axis=1)
    return np.where(n > 0, after.astype(np.float64), np.nan)


def sliding(spec: Rolled, x: np.ndarray) -> np.ndarray:
    """The statistic at each place of x, whose windows reach back to its start at most."""
    padded = np.concatenate((np.full(spec.n - 1, np.nan), x))
    step = max(WINDOW_CELLS // spec.n, 1)
    views = np.lib.stride_tricks.sliding_window_view(padded, spec.n)
    return np.concatenate([_windowed(spec, views[at : at + step]) for at in range(0, len(x), step)]) if len(x) else x


def recurrence(x: np.ndarray, decay: float) -> np.ndarray:
    """y[t] = decay * y[t - 1] + x[t], from 0, by prefix sums over stretches whose powers stay in range."""
    if decay <= 0:
        return x.copy()
    step = max(int(FARTHEST / -math.log(decay)), 1) if decay < 1 else len(x)
    out, before = np.empty(len(x)), 0.0
    for at in range(0, len(x), step):
        part = x[at : at + step]
        power = decay ** np.arange(1, len(part) + 1)
        out[at : at + step] = np.cumsum(part / power) * power + before * power
        before = out[at + len(part) - 1]
    return out


def numbered(panel: DataFrame, name: str) -> DataFrame:
    """panel with its row's number within the instrument, from 0 by datetime, in column `name`; no task sees a whole instrument.

    Rows are dealt by ranges of (instrument, datetime) and numbered within them;
    the counts of ranges before give the rest.
    """
    columns = panel.columns
    at = columns.index("instrument")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array(batch.column(at).to_pylist(), object)
            new = np.concatenate(([key[0] != last], key[1:] != key[:-1]))
            place = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            place[np.cumsum(new) == 0] += n  # the instrument goes on from the batch before
            last, n = key[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(key), part)), pa.array(place)], names=[*columns, "_part", "_place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema) + ", _part long, _place long"
    ranged = stored(panel.repartitionByRange("instrument", "datetime").sortWithinPartitions("instrument", "datetime").mapInArrow(run, schema), "numbered")
    counts = ranged.groupBy(F.col("instrument").alias("_of"), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_of").orderBy("_in")) - F.col("_n")).drop("_n")
    joined = ranged.join(before, (F.col("_part") == F.col("_in")) & F.col("instrument").eqNullSafe(F.col("_of")))
    return joined.select(*(F.col(f"`{c}`") for c in columns), (F.col("_before") + F.col("_place")).alias(name))


def _runs(columns: int, one: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow of a function of each run of rows with equal values in the last two of `columns` columns, instrument and block; runs are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                yield one(pa.Table.from_batches(held).combine_chunks())
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array(batch.column(columns - 2).to_pylist(), object)
            block = batch.column(columns - 1).to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(key)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if (key[low], block[low]) != last:
                    yield from flushed()
                    last = key[low], block[low]
                held.append(batch.slice(low, high - low))
        yield from flushed()

    return run


def rolled(panel: DataFrame, statistics: dict[str, Rolled], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """panel with a column for each statistic, by name, over the instrument's rows in order of datetime.

    Columns of the panel must not start with an underscore.  Null and NaN are no
    values; a result without a value is null.  Rows that repeat a key count as
    rows of their own, in any order.  Each row crosses three shuffles, with
    halos of (longest window - 1) / block_rows of the rows besides, whatever the
    statistics are.
    """
    for name, s in statistics.items():
        if s.n < 1 or s.kind == "exponential" and not 0 < s.share:
            raise ValueError(f"{name} has no proper window")
    columns, halo = panel.columns, max((s.n for s in statistics.values()), default=1) - 1
    size = max(block_rows, halo, 1)
    means = {name: s for name, s in statistics.items() if s.kind == "exponential"}
    others = {name: s for name, s in statistics.items() if s.kind != "exponential"}
    own = F.floor(F.col("_row") / size)
    block = F.when(F.col("_row") % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = numbered(panel, "_row").withColumn("_block", F.explode(block)).withColumn("_instrument", F.col("instrument"))
    dealt = dealt.select(*(F.col(f"`{c}`") for c in columns), "_row", "_instrument", "_block")

    def one(t: pa.Table) -> pa.RecordBatch:
        row, here = t.column("_row").to_numpy(), t.column("_block")[0].as_py()
        mine = np.flatnonzero(row // size == here)
        values = {c: np.asarray(t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) for c in {s.column for s in statistics.values()}}
        out = [sliding(s, values[s.column])[mine] for s in others.values()]
        for s in means.values():
            x = values[s.column][mine]
            there = ~np.isnan(x)
            out += [recurrence(np.where(there, x, 0.0), 1 - s.share), recurrence(there.astype(np.float64), 1 - s.share)]
        kept = t.take(pa.array(mine))
        arrays = [kept.column(c).combine_chunks() for c in (*columns, "_row", "_block")] + [pa.array(v, from_pandas=True) for v in out]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    made = [*others, *(f"_{part}_{i}" for i in range(len(means)) for part in ("sum", "weight"))]
    names = [*columns, "_row", "_block", *made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema), "_row long", "_block long", *(f"`{c}` double" for c in made)])
    local = dealt.repartition("_instrument", "_block").sortWithinPartitions("_instrument", "_block", "_row").mapInArrow(_runs(len(columns) + 3, one), schema)
    if not means:
        return local.select(*(F.col(f"`{c}`") for c in columns), *others)
    return _carried(stored(local, "blocks"), columns, list(others), means, size)


def _decayed(decay: float) -> Callable[[Column, Column], Column]:
    return lambda so_far, block: so_far * decay + block


def _carried(local: DataFrame, columns: list[str], others: list[str], means: dict[str, Rolled], size: int) -> DataFrame:
    """Adds to each block's sums what the blocks before leave, and divides by the weights."""
    of_one = Window.partitionBy("instrument").orderBy("_block")
    ends = local.where(F.col("_row") % size == size - 1)  # blocks with one after them are full
    left: list[Column] = []
    for i, s in enumerate(means.values()):
        decay = max(1 - s.share, 0.0) ** size
        reach = 1 if decay <= 0 else max(1, math.ceil(FARTHEST / -math.log(decay)))  # beyond it, nothing is left
        for part in ("sum", "weight"):
            seen = F.collect_list(f"_{part}_{i}").over(of_one.rowsBetween(1 - reach, 0))
            left.append(F.aggregate(seen, F.lit(0.0), _decayed(decay)).alias(f"_{part}_before_{i}"))
    before = ends.select(F.col("instrument").alias("_of"), (F.col("_block") + 1).alias("_at"), *left)
    joined = local.join(before, (F.col("_block") == F.col("_at")) & F.col("instrument").eqNullSafe(F.col("_of")), "left")
    out = []
    for i, (name, s) in enumerate(means.items()):
        power = F.pow(F.lit(max(1 - s.share, 0.0)), (F.col("_row") % size + 1).cast("double"))
        total, weight = (F.col(f"_{p}_{i}") + F.coalesce(F.col(f"_{p}_before_{i}") * power, F.lit(0.0)) for p in ("sum", "weight"))
        out.append(F.try_divide(total, weight).alias(name))
    return joined.select(*(F.col(f"`{c}`") for c in columns), *others, *out)


def dynamic_bands(panel: DataFrame, column: str, length: str, low: str = "lower", middle: str = "middle", high: str = "upper") -> DataFrame:
    """panel with the mean of as many values as the column `length` says, and the mean less and plus their deviation.

    Prefix sums of values and squares are taken off those at the window's own
    start, which a join by instrument and number of value finds.  Windows end at
    the row and reach back over its values, null ones left out, all of them at
    most.  A row whose length is null or below 1 has nulls, and one value has no
    deviation.  Values are taken from the instrument's mean, for the digits.
    """
    value = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    so_far = Window.partitionBy("instrument").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    x = panel.withColumn("_level", F.avg(value).over(Window.partitionBy("instrument"))).withColumn("_x", value - F.col("_level"))
    x = x.withColumns({"_c": F.count("_x").over(so_far), "_s": F.coalesce(F.sum("_x").over(so_far), F.lit(0.0)), "_q": F.coalesce(F.sum(F.col("_x") * F.col("_x")).over(so_far), F.lit(0.0))})
    x = x.withColumn("_n", F.least(F.floor(F.col(length).cast("double")), F.col("_c")))
    starts = x.where("_x is not null").select(F.col("instrument").alias("_of"), F.col("_c").alias("_at"), F.col("_s").alias("_s0"), F.col("_q").alias("_q0"))
    joined = x.join(starts, (F.col("_c") - F.col("_n") == F.col("_at")) & F.col("instrument").eqNullSafe(F.col("_of")), "left")
    some, n = F.col("_n") >= 1, F.col("_n")
    total, squares = F.col("_s") - F.coalesce("_s0", F.lit(0.0)), F.col("_q") - F.coalesce("_q0", F.lit(0.0))
    mean = F.when(some, total / n)
    spread = F.when(n > 1, F.sqrt(F.greatest(squares - total * mean, F.lit(0.0)) / (n - 1)))
    return joined.select(*(F.col(f"`{c}`") for c in panel.columns), (F.col("_level") + mean - spread).alias(low), (F.col("_level") + mean).alias(middle), (F.col("_level") + mean + spread).alias(high))
