"""Column functions over a daily panel keyed by (datetime, instrument).

Element-wise functions, cross-sectional ones (over the rows of a date) and
rolling ones (over the last n observed rows of an instrument, the current one
included).  All return Spark columns, so any number of them share one shuffle
by instrument and one by date.  A NaN or infinity counts as null: cross-
sectional functions take it as such, and where an element-wise function makes
one, null is what leaves it.  Rolling functions want n non-null values in the window unless
they are said to be loose.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Value = Column | str | float | int


def by_time() -> WindowSpec:
    return Window.partitionBy("instrument").orderBy("datetime")


def by_date() -> WindowSpec:
    return Window.partitionBy("datetime")


def col(x: Value) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def last(n: int) -> WindowSpec:
    return by_time().rowsBetween(1 - n, 0)


def finite(x: Value) -> Column:
    """x, or null where it is NaN or infinite."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


# --- element-wise -----------------------------------------------------------


def add(a: Value, b: Value) -> Column:
    return col(a) + col(b)


def subtract(a: Value, b: Value) -> Column:
    return col(a) - col(b)


def multiply(a: Value, b: Value) -> Column:
    return finite(col(a) * col(b))


def divide(a: Value, b: Value) -> Column:
    return finite(F.try_divide(col(a), col(b)))


def neg(a: Value) -> Column:
    return -col(a)


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a null condition is 0.0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def gt(a: Value, b: Value) -> Column:
    return flag(col(a) > col(b))


def ge(a: Value, b: Value) -> Column:
    return flag(col(a) >= col(b))


def lt(a: Value, b: Value) -> Column:
    return flag(col(a) < col(b))


def le(a: Value, b: Value) -> Column:
    return flag(col(a) <= col(b))


def eq(a: Value, b: Value) -> Column:
    return flag(col(a) == col(b))


def ne(a: Value, b: Value) -> Column:
    return flag(col(a) != col(b))


def _true(a: Value) -> Column:
    return F.coalesce(col(a), F.lit(0.0)) != 0


def both(a: Value, b: Value) -> Column:
    return flag(_true(a) & _true(b))


def either(a: Value, b: Value) -> Column:
    return flag(_true(a) | _true(b))


def where(condition: Value, a: Value, b: Value) -> Column:
    return F.when(_true(condition), col(a)).otherwise(col(b))


def sign(a: Value) -> Column:
    """-1, 0 or 1; a null is 0."""
    return F.when(col(a) > 0, 1.0).when(col(a) < 0, -1.0).otherwise(0.0)


def log(a: Value) -> Column:
    return F.when(col(a) > 0, F.ln(col(a)))


def sqrt(a: Value) -> Column:
    return F.when(col(a) >= 0, F.sqrt(col(a)))


def power(a: Value, exponent: float) -> Column:
    return finite(F.pow(col(a), F.lit(float(exponent))))


def inv(a: Value) -> Column:
    return divide(1.0, a)


def exp(a: Value) -> Column:
    return finite(F.exp(col(a)))


def floor(a: Value) -> Column:
    return F.floor(col(a)).cast("double")


def greater(*values: Value) -> Column:
    """Largest of the non-null values."""
    return F.greatest(*map(col, values))


def less(*values: Value) -> Column:
    return F.least(*map(col, values))


def masked(a: Value, condition: Value) -> Column:
    """a times the condition: 0 where it does not hold."""
    return col(a) * col(condition)


def fill_null(a: Value, value: float) -> Column:
    return F.coalesce(finite(a), F.lit(float(value)))


# --- cross-sectional --------------------------------------------------------


def average_rank(x: Value, by: tuple[str, ...] = ("datetime",)) -> Column:
    """Rank among the non-null values of the group, equal values sharing their mean rank."""
    x = finite(x)
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def cs_rank(x: Value) -> Column:
    return average_rank(x) / F.count(finite(x)).over(by_date())


def cs_mean(x: Value) -> Column:
    return F.avg(finite(x)).over(by_date())


def cs_std(x: Value) -> Column:
    return F.stddev_samp(finite(x)).over(by_date())


def cs_skew(x: Value) -> Column:
    n = F.count(finite(x)).over(by_date())
    return F.coalesce(F.skewness(finite(x)).over(by_date()) * F.pow((n - 1) / n, F.lit(1.5)), F.lit(0.0))


def _unbiased_kurtosis(population: Column, n: Column) -> Column:
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6))


def cs_kurt(x: Value) -> Column:
    return _unbiased_kurtosis(F.kurtosis(finite(x)).over(by_date()), F.count(finite(x)).over(by_date()))


def cs_median(x: Value) -> Column:
    return F.median(finite(x)).over(by_date())


def cs_max(x: Value) -> Column:
    return F.max(finite(x)).over(by_date())


def cs_min(x: Value) -> Column:
    return F.min(finite(x)).over(by_date())


def _standard(x: Value, mean: Column, deviation: Column) -> Column:
    x = finite(x)
    return F.when(x.isNull(), None).when(F.coalesce(deviation, F.lit(0.0)) == 0, 0.0).otherwise(F.try_divide(x - mean, deviation))


def cs_zscore(x: Value) -> Column:
    return _standard(x, cs_mean(x), cs_std(x))


def cs_scale(x: Value, total: float = 1.0) -> Column:
    return F.try_divide(finite(x) * total, F.sum(F.abs(finite(x))).over(by_date()))


def cs_fill_null(x: Value) -> Column:
    return F.coalesce(finite(x), F.avg(finite(x)).over(by_date()), F.lit(0.0))


def cs_rank_norm(x: Value) -> Column:
    """Average rank over all rows of the date, centred and scaled to unit deviation."""
    return (average_rank(x) / F.count(F.lit(1)).over(by_date()) - 0.5) * 3.46


# --- rolling ----------------------------------------------------------------


def delay(x: Value, k: int = 1) -> Column:
    """x k rows before; a negative k looks ahead and is for labels only."""
    return F.lag(col(x), k).over(by_time())


def delta(x: Value, k: int = 1) -> Column:
    return col(x) - delay(x, k)


def _full(x: Value, n: int, value: Column) -> Column:
    return F.when(F.count(col(x)).over(last(n)) >= n, value)


def ts_mean(x: Value, n: int) -> Column:
    return _full(x, n, F.avg(col(x)).over(last(n)))


def ts_sum(x: Value, n: int) -> Column:
    return _full(x, n, F.sum(col(x)).over(last(n)))


def ts_prod(x: Value, n: int) -> Column:
    """Loose: the product of what the window has."""
    return F.product(col(x)).over(last(n))


def ts_std(x: Value, n: int) -> Column:
    return _full(x, n, F.stddev_samp(col(x)).over(last(n)))


def ts_var(x: Value, n: int) -> Column:
    return _full(x, n, F.var_samp(col(x)).over(last(n)))


def ts_skew(x: Value, n: int) -> Column:
    return _full(x, n, F.skewness(col(x)).over(last(n)))


def ts_kurt(x: Value, n: int) -> Column:
    return _unbiased_kurtosis(F.kurtosis(col(x)).over(last(n)), F.count(col(x)).over(last(n)))


def ts_min(x: Value, n: int) -> Column:
    return _full(x, n, F.min(col(x)).over(last(n)))


def ts_max(x: Value, n: int) -> Column:
    return _full(x, n, F.max(col(x)).over(last(n)))


def ts_quantile(x: Value, n: int, q: float) -> Column:
    return _full(x, n, F.percentile(col(x), F.lit(q)).over(last(n)))


def ts_median(x: Value, n: int) -> Column:
    return ts_quantile(x, n, 0.5)


def percentile(x: Value, q: float, n: int | None = None) -> Column:
    """Rolling with n; without it over the instrument's whole history, which looks ahead."""
    return F.percentile(col(x), F.lit(q)).over(Window.partitionBy("instrument")) if n is None else ts_quantile(x, n, q)


def _values(x: Value, n: int) -> Column:
    """The window's non-null values, oldest first."""
    return F.collect_list(col(x)).over(last(n))


def _middle(sorted_values: Column) -> Column:
    size = F.size(sorted_values)
    low, high = F.floor((size - 1) / 2).cast("int"), F.floor(size / 2).cast("int")
    return F.when(size > 0, (F.get(sorted_values, low) + F.get(sorted_values, high)) / 2)


def ts_mad(x: Value, n: int) -> Column:
    """Loose: median distance from the median."""
    values = _values(x, n)
    middle = _middle(F.sort_array(values))
    return _middle(F.sort_array(F.transform(values, lambda v: F.abs(v - middle))))


def ts_rank(x: Value, n: int) -> Column:
    x, values = col(x), _values(x, n)
    below, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return _full(x, n, (below + (same + 1) / 2) / F.size(values))


def ts_zscore(x: Value, n: int) -> Column:
    return _standard(x, ts_mean(x, n), ts_std(x, n))


def ts_pctchange(x: Value, k: int = 1) -> Column:
    return finite(F.try_divide(col(x), delay(x, k)) - 1)


def ts_argmax(x: Value, n: int) -> Column:
    """Place of the first largest value, 1 at the window's start."""
    values = _values(x, n)
    return _full(x, n, F.array_position(values, F.array_max(values)).cast("double"))


def ts_argmin(x: Value, n: int) -> Column:
    values = _values(x, n)
    return _full(x, n, F.array_position(values, F.array_min(values)).cast("double"))


def highday(x: Value, n: int) -> Column:
    """Rows since the largest value, 1 for the current row."""
    values = _values(x, n)
    return (F.size(values) - F.array_position(values, F.array_max(values)) + 1).cast("double")


def lowday(x: Value, n: int) -> Column:
    values = _values(x, n)
    return (F.size(values) - F.array_position(values, F.array_min(values)) + 1).cast("double")


def _pair(x: Value, y: Value) -> tuple[Column, Column]:
    """Both columns, null where either is."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def ts_corr(x: Value, y: Value, n: int) -> Column:
    a, b = _pair(x, y)
    w = last(n)
    return _full(a, n, finite(F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))))


def row_in_history() -> Column:
    return F.row_number().over(by_time()).cast("double")


def ts_corr_sequence(x: Value, n: int) -> Column:
    return ts_corr(x, row_in_history(), n)


def ts_autocorr(x: Value, n: int) -> Column:
    return ts_corr(x, delay(x, 1), n)


def ts_covariance(x: Value, y: Value, n: int) -> Column:
    return F.covar_samp(*_pair(x, y)).over(last(n))


def ts_slope(x: Value, n: int) -> Column:
    return _full(x, n, F.regr_slope(col(x), row_in_history()).over(last(n)))


def ts_rsquare(x: Value, n: int) -> Column:
    """Null for a window that hardly varies."""
    return _full(x, n, F.when(F.var_pop(col(x)).over(last(n)) > 4e-10, F.regr_r2(col(x), row_in_history()).over(last(n))))


def ts_resi(x: Value, n: int) -> Column:
    at, w = row_in_history(), last(n)
    return _full(x, n, col(x) - (F.regr_intercept(col(x), at).over(w) + F.regr_slope(col(x), at).over(w) * at))


def _varies(a: Column, b: Column, n: int, value: Column) -> Column:
    return _full(a, n, F.when(F.var_pop(b).over(last(n)) > 0, value))


def regbeta(y: Value, x: Value, n: int) -> Column:
    a, b = _pair(y, x)
    return _varies(a, b, n, F.regr_slope(a, b).over(last(n)))


def regresi(y: Value, x: Value, n: int) -> Column:
    a, b = _pair(y, x)
    w = last(n)
    return _varies(a, b, n, a - (F.regr_intercept(a, b).over(w) + F.regr_slope(a, b).over(w) * b))


def regbeta_constant(y: Value, c: float, n: int) -> Column:
    """Least-norm slope on a constant regressor."""
    return ts_mean(y, n) * (c / (c * c + 1))


def regresi_constant(y: Value, c: float, n: int) -> Column:
    return col(y) - ts_mean(y, n)


def count(condition: Value, n: int) -> Column:
    return F.when(row_in_history() >= n, F.sum(_true(condition).cast("double")).over(last(n)))


def sumif(x: Value, n: int, condition: Value) -> Column:
    return ts_sum(F.when(col(x).isNotNull(), F.when(_true(condition), col(x)).otherwise(0.0)), n)


def decay_linear(x: Value, n: int) -> Column:
    values = _values(x, n)
    total = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return _full(x, n, total / (n * (n + 1) / 2))


def _ewm(x: Value, alpha: float) -> Column:
    """Weights (1 - alpha)^age, normalised; cut where a weight falls under 1e-16; a null keeps its age."""
    terms = 1 if alpha >= 1 else math.ceil(math.log(1e-16) / math.log(1 - alpha))
    values = F.reverse(F.collect_list(F.struct(col(x).alias("v"))).over(last(terms)))
    seen = F.filter(F.transform(values, lambda s, i: F.struct(s["v"].alias("v"), F.pow(F.lit(1 - alpha), i.cast("double")).alias("w"))), lambda s: s["v"].isNotNull())
    zero = F.lit(0.0)
    return F.try_divide(F.aggregate(seen, zero, lambda a, s: a + s["v"] * s["w"]), F.aggregate(seen, zero, lambda a, s: a + s["w"]))


def ema(x: Value, n: int) -> Column:
    return _ewm(x, 2 / (n + 1))


def sma(x: Value, m: int, n: int | None = None) -> Column:
    """Loose mean of m rows, or with n an exponential mean of weight n / m."""
    return F.avg(col(x)).over(last(m)) if n is None else _ewm(x, n / m)


def wma(x: Value, n: int) -> Column:
    """Loose: weights 0.9^age over the window's non-null values."""
    weighed = F.transform(F.reverse(_values(x, n)), lambda v, i: F.struct((v * F.pow(F.lit(0.9), i.cast("double"))).alias("v"), F.pow(F.lit(0.9), i.cast("double")).alias("w")))
    zero = F.lit(0.0)
    return F.try_divide(F.aggregate(weighed, zero, lambda a, s: a + s["v"]), F.aggregate(weighed, zero, lambda a, s: a + s["w"]))


def macd(x: Value, short: int = 12, long: int = 26) -> Column:
    return ema(x, short) - ema(x, long)


def rsi(x: Value, n: int = 14) -> Column:
    up, down = greater(delta(x), 0.0), greater(-delta(x), 0.0)
    move = delta(x).isNotNull()
    ratio = F.try_divide(ema(F.when(move, up), n), ema(F.when(move, down), n))
    return 100 - F.try_divide(F.lit(100.0), 1 + ratio)


def bb_middle(x: Value, n: int) -> Column:
    return F.avg(col(x)).over(last(n))


def bb_upper(x: Value, n: int) -> Column:
    return bb_middle(x, n) + F.stddev_samp(col(x)).over(last(n))


def bb_lower(x: Value, n: int) -> Column:
    return bb_middle(x, n) - F.stddev_samp(col(x)).over(last(n))


def bb_middle_dynamic(x: Value, n: Value) -> Column:
    """Mean of as many rows as the column n says."""
    values = F.collect_list(col(x)).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    size = F.least(col(n).cast("int"), F.size(values))
    part = F.slice(values, F.size(values) - size + 1, size)
    return F.when(size > 0, F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / size)
