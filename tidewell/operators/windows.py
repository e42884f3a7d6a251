"""Many statistics of full rolling windows in one pass.

A window expression of Spark goes over the window anew for each row and each
expression; sets of factors have more than a hundred of them.  Here `Windows`
notes down what a set asks for, and `over` computes it in Arrow batches: an
instrument's rows come in order, each batch with the rows before it that its
windows reach back to, and a statistic takes one step for all rows of the batch
at once, oldest value of the windows first.  The steps are those of Spark's
aggregates, so that the digits are the same.  What statistics have in common is
computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

HARDLY_VARIES = 4e-10


class Windows:
    """Functions of `functions.columns` by the same names, which note down what they are asked for.

    They return columns of the panel that `over` gives.  Their arguments are
    names of the panel's columns, or expressions of its columns and of delays;
    an expression that several share should be one object.
    """

    def __init__(self) -> None:
        self._delays: dict[str, tuple[str, int]] = {}
        self._inputs: dict[str | int, tuple[str, Column]] = {}
        self._statistics: dict[str, tuple] = {}

    def delay(self, x: str, k: int = 1) -> Column:
        name = f"_delay_{x}_{k}"
        self._delays[name] = (x, k)
        return F.col(name)

    def ts_pctchange(self, x: str, k: int = 1) -> Column:
        return c.finite(F.try_divide(F.col(x), self.delay(x, k)) - 1)

    def _input(self, x: Column | str) -> str:
        if isinstance(x, str):
            return self._inputs.setdefault(x, (f"_of_{x}", F.col(x)))[0]
        return self._inputs.setdefault(id(x), (f"_x{len(self._inputs)}", x))[0]  # kept there, so that its id stays its own

    def _add(self, kind: str, x: Column | str, n: int, more: str | float = "") -> Column:
        spec = (kind, self._input(x), n, more)
        name = "_" + "_".join(map(str, spec)).replace(".", "_")
        self._statistics[name] = spec
        return F.col(name)

    def ts_mean(self, x: Column | str, n: int) -> Column:
        return self._add("mean", x, n)

    def ts_sum(self, x: Column | str, n: int) -> Column:
        return self._add("sum", x, n)

    def ts_std(self, x: Column | str, n: int) -> Column:
        return self._add("std", x, n)

    def ts_min(self, x: Column | str, n: int) -> Column:
        return self._add("min", x, n)

    def ts_max(self, x: Column | str, n: int) -> Column:
        return self._add("max", x, n)

    def ts_argmin(self, x: Column | str, n: int) -> Column:
        return self._add("argmin", x, n)

    def ts_argmax(self, x: Column | str, n: int) -> Column:
        return self._add("argmax", x, n)

    def ts_rank(self, x: Column | str, n: int) -> Column:
        return self._add("rank", x, n)

    def ts_quantile(self, x: Column | str, n: int, q: float) -> Column:
        return self._add("quantile", x, n, q)

    def ts_slope(self, x: Column | str, n: int) -> Column:
        return self._add("slope", x, n)

    def ts_rsquare(self, x: Column | str, n: int) -> Column:
        return self._add("rsquare", x, n)

    def ts_resi(self, x: Column | str, n: int) -> Column:
        return self._add("resi", x, n)

    def ts_corr(self, x: Column | str, y: Column | str, n: int) -> Column:
        return self._add("corr", x, n, self._input(y))

    def over(self, panel: DataFrame) -> DataFrame:
        """panel with the columns of all delays and statistics so far.

        Its columns must not start with an underscore.  Rows cross one shuffle,
        by instrument; a task holds a batch and the longest window less one.
        """
        time = c.by_time()
        x = panel.repartition("instrument").withColumns({name: F.lag(of, k).over(time) for name, (of, k) in self._delays.items()} | {"_at": F.row_number().over(time)})
        kept = x.drop("_at")
        inputs = dict(self._inputs.values())
        x = x.select(*(F.col(f"`{k}`") for k in kept.columns), "_at", *(v.cast("double").alias(k) for k, v in inputs.items())).sortWithinPartitions("instrument", "_at")
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"`{name}` double" for name in self._statistics)])
        return x.mapInArrow(_runner(kept.columns, list(inputs), dict(self._statistics)), schema)


def _runner(kept: list[str], inputs: list[str], statistics: dict[str, tuple]):
    reach = max((n for _, _, n, _ in statistics.values()), default=1) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = {name: np.full(reach, np.nan) for name in inputs}
        there = {name: np.zeros(reach, bool) for name in inputs}
        for batch in batches:
            if not batch.num_rows:
                continue
            for name in inputs:
                x = batch.column(name)
                values[name] = np.concatenate((values[name], x.to_numpy(zero_copy_only=False)))
                there[name] = np.concatenate((there[name], x.is_valid().to_numpy(zero_copy_only=False)))
            rows = _Rows(batch.column("_at").to_numpy(), values, there, reach)
            with np.errstate(all="ignore"):
                arrays = [batch.column(name) for name in kept] + [rows.statistic(*spec) for spec in statistics.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *statistics])
            values = {name: v[len(v) - reach :].copy() for name, v in values.items()}
            there = {name: v[len(v) - reach :].copy() for name, v in there.items()}

    return run


class _Rows:
    """A batch's rows, `at` their numbers within the instrument from 1, with the values of `reach` rows before them."""

    def __init__(self, at: np.ndarray, values: dict[str, np.ndarray], there: dict[str, np.ndarray], reach: int):
        self.at, self.values, self.reach, self.count = at, values, reach, len(at)
        self.unbroken = {}  # values without a null up to the row
        for name, ok in there.items():
            place = np.arange(len(ok))
            self.unbroken[name] = (place - np.maximum.accumulate(np.where(ok, -1, place)))[reach:]
        self.known: dict[tuple, tuple] = {}

    def steps(self, name: str, n: int) -> Iterator[np.ndarray]:
        """The windows' values at all rows, oldest first."""
        for back in range(n - 1, -1, -1):
            low = self.reach - back
            yield self.values[name][low : low + self.count]

    def own(self, name: str) -> np.ndarray:
        return self.values[name][self.reach :]

    def statistic(self, kind: str, x: str, n: int, more: str | float) -> pa.Array:
        full = (self.at >= n) & (self.unbroken[x] >= n)
        if kind == "corr":
            full &= self.unbroken[more] >= n
        if not full.any():
            return pa.nulls(self.count, pa.float64())
        out, some = getattr(self, f"_{kind}")(x, n, more), full
        if isinstance(out, tuple):
            out, some = out[0], full & out[1]
        return pa.array(out, pa.float64(), mask=~some)

    def _shared(self, f, *key):
        if (f, *key) not in self.known:
            self.known[(f, *key)] = f(*key)
        return self.known[(f, *key)]

    def _total(self, x: str, n: int) -> np.ndarray:
        out = np.zeros(self.count)
        for v in self.steps(x, n):
            out += v
        return out

    def _moments(self, x: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and sum of squared deviations."""
        mean, squares = np.zeros(self.count), np.zeros(self.count)
        for i, v in enumerate(self.steps(x, n), 1):
            delta = v - mean
            part = delta / i
            mean += part
            squares += delta * (delta - part)
        return mean, squares

    def _numbers(self, n: int) -> Iterator[np.ndarray]:
        return ((self.at - back).astype(np.float64) for back in range(n - 1, -1, -1))

    def _products(self, x: str, y: str, n: int) -> np.ndarray:
        """Sum of products of deviations."""
        a, b, out = np.zeros(self.count), np.zeros(self.count), np.zeros(self.count)
        for i, (v, w) in enumerate(zip(self.steps(x, n), self.steps(y, n), strict=True), 1):
            dx = v - a
            a += dx / i
            b += (w - b) / i
            out += dx * (w - b)
        return out

    def _line(self, x: str, n: int) -> tuple[np.ndarray, ...]:
        """The values' line over row numbers: both means, the numbers' squares and products by the steps of a slope, both squares and products by those of a correlation."""
        a, b, squares, products, aa, bb, ab = (np.zeros(self.count) for _ in range(7))
        for i, (t, v) in enumerate(zip(self._numbers(n), self.steps(x, n), strict=True), 1):
            dt, dv = t - a, v - b
            part = dt / i
            a += part
            b += dv / i
            squares += dt * (dt - part)
            products += dt * (v - b)
            aa += dt * (t - a)
            bb += dv * (v - b)
            ab += dv * (t - a)
        return a, b, squares, products, aa, bb, ab

    def _sum(self, x, n, _):
        return self._shared(self._total, x, n)

    def _mean(self, x, n, _):
        return self._shared(self._total, x, n) / n

    def _std(self, x, n, _):
        return np.sqrt(self._shared(self._moments, x, n)[1] / (n - 1)), np.full(self.count, n > 1)

    def _min(self, x, n, _):
        """NaN is the largest value, here and below."""
        out = np.full(self.count, np.nan)
        for v in self.steps(x, n):
            np.fmin(out, v, out=out)
        return out

    def _max(self, x, n, _):
        out = np.full(self.count, -np.inf)
        for v in self.steps(x, n):
            np.maximum(out, v, out=out)
        return out

    def _argmax(self, x, n, _):
        best = place = None
        for i, v in enumerate(self.steps(x, n), 1):
            if best is None:
                best, place = v.copy(), np.ones(self.count)
                continue
            better = ~(v <= best) & (best == best)
            best[better], place[better] = v[better], i
        return place

    def _argmin(self, x, n, _):
        best = place = None
        for i, v in enumerate(self.steps(x, n), 1):
            if best is None:
                best, place = v.copy(), np.ones(self.count)
                continue
            better = ~(v >= best) & (v == v)
            best[better], place[better] = v[better], i
        return place

    def _rank(self, x, n, _):
        own = self.own(x)
        odd, below, same = own != own, np.zeros(self.count), np.zeros(self.count)
        for v in self.steps(x, n):
            below += ~(v >= own) & (v == v)
            same += (v == own) | (odd & (v != v))
        return (below + (same + 1) / 2) / n

    def _sorted(self, x: str, n: int) -> np.ndarray:
        low = self.reach - n + 1
        return np.sort(np.lib.stride_tricks.sliding_window_view(self.values[x][low:], n), axis=1)

    def _quantile(self, x, n, q):
        window, place = self._shared(self._sorted, x, n), (n - 1) * q
        low, high = int(np.floor(place)), int(np.ceil(place))
        a, b = window[:, low], window[:, high]
        return a if low == high else np.where(a == b, a, (high - place) * a + (place - low) * b)

    def _slope(self, x, n, _):
        _, _, squares, products, *_ = self._shared(self._line, x, n)
        return products / squares, squares != 0

    def _resi(self, x, n, _):
        at, mean, squares, products, *_ = self._shared(self._line, x, n)
        slope = products / squares
        return self.own(x) - ((mean - slope * at) + slope * self.at), squares != 0

    def _rsquare(self, x, n, _):
        *_, aa, bb, ab = self._shared(self._line, x, n)
        r = ab / np.sqrt(bb * aa)
        return np.where(bb == 0, 1.0, r * r), ~(self._shared(self._moments, x, n)[1] / n <= HARDLY_VARIES) & (aa != 0)

    def _corr(self, x, n, y):
        a, b = (np.sqrt(self._shared(self._moments, v, n)[1] / n) for v in (x, y))
        out = self._shared(self._products, x, y, n) / n / (a * b)
        return out, (a * b != 0) & np.isfinite(out)
