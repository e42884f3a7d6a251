"""One query for each function of the panel language, with its SQL twin.

The Spark side and the SQL side are written separately; both are rounded alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import rolling as ro
from ..sources import events_panel

PANEL_SQL = """p AS (
SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS datetime, arg_min(value, {'a': ts, 'b': event_id}) AS open, arg_max(value, {'a': ts, 'b': event_id}) AS close,
max(value) AS high, min(value) AS low, CAST(count(*) AS DOUBLE) AS volume, sum(value) / count(*) AS vwap FROM events GROUP BY 1, 2)"""


#: Moves decimal ties off the edge, where two engines may round apart.
NUDGE = 1.7e-8


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double") + NUDGE, digits) + 0.0


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE) + {NUDGE}, {digits}) + 0.0"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


TIME = "OVER (PARTITION BY instrument ORDER BY datetime)"
DATE = "OVER (PARTITION BY datetime)"


def full(n: int, value: str, x: str = "close") -> str:
    return f"CASE WHEN count({x}) {rows(n)} >= {n} THEN {value} END"


def ewm(x: str, alpha: float, name: str) -> str:
    """A list aggregate over (value, age) pairs, for use in a second step."""
    return f"list_sum(list_transform(range(1, len({name}) + 1), lambda i: coalesce({name}[i], 0) * pow({1 - alpha!r}, len({name}) - i))) / nullif(list_sum(list_transform(range(1, len({name}) + 1), lambda i: CASE WHEN {name}[i] IS NULL THEN 0 ELSE pow({1 - alpha!r}, len({name}) - i) END)), 0)"


RN = f"row_number() {TIME}"
#: Columns that a second step may use: an offset return with nulls, lags, and window lists.
STEP = f"""q AS (SELECT *, lag(close) {TIME} AS prev, lag(open, 2) {TIME} AS open2, CAST({RN} AS DOUBLE) AS rn,
list(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lall,
list(close) {rows(5)} AS l5 FROM p),
r AS (SELECT *, close - prev AS d,
list(CASE WHEN prev IS NULL THEN NULL ELSE greatest(close - prev, 0) END) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lup,
list(CASE WHEN prev IS NULL THEN NULL ELSE greatest(prev - close, 0) END) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ldown FROM q)"""


def prev() -> Column:
    return c.delay("close", 1)


def _rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY datetime ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY datetime, {x}) - 1) / 2.0) END"


_slope = f"regr_slope(close, rn) {rows(5)}"
_cov = f"covar_pop(close, volume) {rows(5)}"
_varies = f"var_pop(volume) {rows(5)} > 0"
_mean, _sd = f"avg(close) {rows(5)}", f"stddev_samp(close) {rows(5)}"
_gap = "(close - prev)"

OPS: dict[str, tuple[Callable[[], Column], str]] = {
    # element-wise
    "elem_add": (lambda: c.add("close", prev()), "close + prev"),
    "elem_subtract": (lambda: c.subtract("close", prev()), "close - prev"),
    "elem_multiply": (lambda: c.multiply("close", "open"), "close * open"),
    "elem_divide": (lambda: c.divide("close", c.subtract("high", "low")), "close / nullif(high - low, 0)"),
    "elem_neg": (lambda: c.neg("close"), "-close"),
    "elem_gt": (lambda: c.gt("close", prev()), "CASE WHEN close > prev THEN 1.0 ELSE 0.0 END"),
    "elem_ge": (lambda: c.ge("close", "high"), "CASE WHEN close >= high THEN 1.0 ELSE 0.0 END"),
    "elem_lt": (lambda: c.lt("close", prev()), "CASE WHEN close < prev THEN 1.0 ELSE 0.0 END"),
    "elem_le": (lambda: c.le("close", "low"), "CASE WHEN close <= low THEN 1.0 ELSE 0.0 END"),
    "elem_eq": (lambda: c.eq("close", "open"), "CASE WHEN close = open THEN 1.0 ELSE 0.0 END"),
    "elem_ne": (lambda: c.ne("close", prev()), "CASE WHEN close <> prev THEN 1.0 ELSE 0.0 END"),
    "elem_and": (lambda: c.both(c.gt("close", prev()), c.gt("volume", 2)), "CASE WHEN close > prev AND volume > 2 THEN 1.0 ELSE 0.0 END"),
    "elem_or": (lambda: c.either(c.gt("close", prev()), c.gt("volume", 2)), "CASE WHEN coalesce(close > prev, false) OR volume > 2 THEN 1.0 ELSE 0.0 END"),
    "elem_where": (lambda: c.where(c.gt("close", prev()), "high", "low"), "CASE WHEN close > prev THEN high ELSE low END"),
    "elem_abs": (lambda: F.abs(c.delta("close")), "abs(close - prev)"),
    "elem_sign": (lambda: c.sign(c.delta("close")), "CASE WHEN close > prev THEN 1.0 WHEN close < prev THEN -1.0 ELSE 0.0 END"),
    "elem_log": (lambda: c.log(c.delta("close")), f"CASE WHEN {_gap} > 0 THEN ln(greatest({_gap}, 1e-300)) END"),
    "elem_sqrt": (lambda: c.sqrt(c.delta("close")), f"CASE WHEN {_gap} >= 0 THEN sqrt(greatest({_gap}, 0)) END"),
    "elem_pow": (lambda: c.power("close", 2), "close * close"),
    "elem_inv": (lambda: c.inv("close"), "1 / nullif(close, 0)"),
    "elem_exp": (lambda: c.exp(c.divide("close", 1000)), "exp(close / 1000)"),
    "elem_floor": (lambda: c.floor("close"), "floor(close)"),
    "elem_greater": (lambda: c.greater("close", prev()), "greatest(close, coalesce(prev, close))"),
    "elem_less": (lambda: c.less("close", prev(), 50.0), "least(close, coalesce(prev, close), 50.0)"),
    "elem_filter": (lambda: c.masked("close", c.gt("volume", 1)), "close * CASE WHEN volume > 1 THEN 1.0 ELSE 0.0 END"),
    "elem_fill_null": (lambda: c.fill_null(prev(), 7), "coalesce(prev, 7)"),
    # cross-sectional
    "cs_rank": (lambda: c.cs_rank(prev()), f"{_rank_sql('prev')} / count(prev) {DATE}"),
    "cs_mean": (lambda: c.cs_mean("close"), f"avg(close) {DATE}"),
    "cs_std": (lambda: c.cs_std("close"), f"stddev_samp(close) {DATE}"),
    "cs_skew": (lambda: c.cs_skew("close"), f"coalesce(skewness(close) {DATE} * (count(close) {DATE} - 2) / sqrt(CAST(count(close) {DATE} AS DOUBLE) * (count(close) {DATE} - 1)) * pow((count(close) {DATE} - 1) / CAST(count(close) {DATE} AS DOUBLE), 1.5), 0)"),
    "cs_kurt": (lambda: c.cs_kurt("close"), f"kurtosis(close) {DATE}"),
    "cs_median": (lambda: c.cs_median("close"), f"median(close) {DATE}"),
    "cs_max": (lambda: c.cs_max("close"), f"max(close) {DATE}"),
    "cs_min": (lambda: c.cs_min("close"), f"min(close) {DATE}"),
    "cs_zscore": (lambda: c.cs_zscore(prev()), f"CASE WHEN prev IS NULL THEN NULL WHEN coalesce(stddev_samp(prev) {DATE}, 0) = 0 THEN 0 ELSE (prev - avg(prev) {DATE}) / stddev_samp(prev) {DATE} END"),
    "cs_scale": (lambda: c.cs_scale("close"), f"close / nullif(sum(abs(close)) {DATE}, 0)"),
    "cs_fill_null": (lambda: c.cs_fill_null(prev()), f"coalesce(prev, avg(prev) {DATE}, 0)"),
    "cs_rank_norm": (lambda: c.cs_rank_norm("close"), f"({_rank_sql('close')} / count(*) {DATE} - 0.5) * 3.46"),
    # rolling
    "ts_delay": (prev, "prev"),
    "ts_label": (lambda: c.divide(c.delay("close", -2), c.delay("close", -1)) - 1, f"lead(close, 2) {TIME} / nullif(lead(close) {TIME}, 0) - 1"),
    "ts_delta": (lambda: c.delta("close", 2), f"close - lag(close, 2) {TIME}"),
    "ts_mean": (lambda: c.ts_mean("close", 5), full(5, _mean)),
    "ts_sum": (lambda: c.ts_sum("close", 5), full(5, f"sum(close) {rows(5)}")),
    "ts_prod": (lambda: c.ts_prod(F.col("close") / 100, 3), f"product(close / 100) {rows(3)}"),
    "ts_std": (lambda: c.ts_std("close", 5), full(5, _sd)),
    "ts_var": (lambda: c.ts_var("close", 5), full(5, f"var_samp(close) {rows(5)}")),
    "ts_skew": (lambda: c.ts_skew("close", 5), full(5, f"skewness(close) {rows(5)} * 3 / sqrt(20.0)")),
    "ts_kurt": (lambda: c.ts_kurt("close", 5), f"kurtosis(close) {rows(5)}"),
    "ts_min": (lambda: c.ts_min("low", 5), full(5, f"min(low) {rows(5)}")),
    "ts_max": (lambda: c.ts_max("high", 5), full(5, f"max(high) {rows(5)}")),
    "ts_median": (lambda: c.ts_median("close", 5), full(5, f"quantile_cont(close, 0.5) {rows(5)}")),
    "ts_quantile": (lambda: c.ts_quantile("close", 5, 0.8), full(5, f"quantile_cont(close, 0.8) {rows(5)}")),
    "ts_percentile_history": (lambda: c.percentile("close", 0.3), "quantile_cont(close, 0.3) OVER (PARTITION BY instrument)"),
    "ts_percentile": (lambda: c.percentile("close", 0.3, 5), full(5, f"quantile_cont(close, 0.3) {rows(5)}")),
    "ts_mad": (lambda: c.ts_mad("close", 5), f"mad(close) {rows(5)}"),
    "ts_rank": (lambda: c.ts_rank("close", 5), full(5, "(len(list_filter(l5, lambda x: x < close)) + (len(list_filter(l5, lambda x: x = close)) + 1) / 2.0) / len(l5)")),
    "ts_zscore": (lambda: c.ts_zscore("close", 5), f"CASE WHEN count(close) {rows(5)} < 5 OR {_sd} = 0 THEN 0 ELSE (close - {_mean}) / {_sd} END"),
    "ts_pctchange": (lambda: c.ts_pctchange("close"), "close / nullif(prev, 0) - 1"),
    "ts_argmax": (lambda: c.ts_argmax("close", 5), full(5, "CAST(list_position(l5, list_max(l5)) AS DOUBLE)")),
    "ts_argmin": (lambda: c.ts_argmin("close", 5), full(5, "CAST(list_position(l5, list_min(l5)) AS DOUBLE)")),
    "ts_highday": (lambda: c.highday("close", 5), "CAST(len(l5) - list_position(l5, list_max(l5)) + 1 AS DOUBLE)"),
    "ts_lowday": (lambda: c.lowday("close", 5), "CAST(len(l5) - list_position(l5, list_min(l5)) + 1 AS DOUBLE)"),
    "ts_corr": (lambda: c.ts_corr("close", "vwap", 5), full(5, f"covar_pop(close, vwap) {rows(5)} / nullif(stddev_pop(close) {rows(5)} * stddev_pop(vwap) {rows(5)}, 0)")),
    "ts_corr_sequence": (lambda: c.ts_corr_sequence("close", 5), full(5, f"covar_pop(close, rn) {rows(5)} / nullif(stddev_pop(close) {rows(5)} * stddev_pop(rn) {rows(5)}, 0)")),
    "ts_autocorr": (lambda: c.ts_autocorr("close", 5), full(5, f"covar_pop(close, prev) {rows(5)} / nullif(stddev_pop(close) {rows(5)} * stddev_pop(prev) {rows(5)}, 0)", "prev")),
    "ts_covariance": (lambda: c.ts_covariance("close", "volume", 5), f"covar_samp(close, volume) {rows(5)}"),
    "ts_slope": (lambda: c.ts_slope("close", 5), full(5, _slope)),
    "ts_rsquare": (lambda: c.ts_rsquare("close", 5), full(5, f"CASE WHEN var_pop(close) {rows(5)} > 4e-10 THEN regr_r2(close, rn) {rows(5)} END")),
    "ts_resi": (lambda: c.ts_resi("close", 5), full(5, f"close - (regr_intercept(close, rn) {rows(5)} + {_slope} * rn)")),
    "ts_regbeta": (lambda: c.regbeta("close", "volume", 5), full(5, f"CASE WHEN {_varies} THEN {_cov} / nullif(var_pop(volume) {rows(5)}, 0) END")),
    "ts_regresi": (lambda: c.regresi("close", "volume", 5), full(5, f"CASE WHEN {_varies} THEN close - ({_mean} + {_cov} / nullif(var_pop(volume) {rows(5)}, 0) * (volume - avg(volume) {rows(5)})) END")),
    "ts_regbeta_constant": (lambda: c.regbeta_constant("close", 3.0, 5), full(5, f"{_mean} * 3.0 / 10.0")),
    "ts_regresi_constant": (lambda: c.regresi_constant("close", 3.0, 5), full(5, f"close - {_mean}")),
    "ts_count": (lambda: c.count(c.gt("close", "open"), 5), f"CASE WHEN rn >= 5 THEN sum(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) {rows(5)} END"),
    "ts_sumif": (lambda: c.sumif("close", 5, c.gt("volume", 2)), full(5, f"sum(CASE WHEN volume > 2 THEN close ELSE 0 END) {rows(5)}")),
    "ts_decay_linear": (lambda: c.decay_linear("close", 5), full(5, "(l5[1] + 2 * l5[2] + 3 * l5[3] + 4 * l5[4] + 5 * l5[5]) / 15")),
    "ts_ema": (lambda: c.ema("close", 5), ewm("close", 2 / 6, "lall")),
    "ts_sma": (lambda: c.sma("close", 5), f"avg(close) {rows(5)}"),
    "ts_sma_weighted": (lambda: c.sma("close", 6, 2), ewm("close", 2 / 6, "lall")),
    "ts_wma": (lambda: c.wma("close", 5), "list_sum(list_transform(range(1, len(l5) + 1), lambda i: l5[i] * pow(0.9, len(l5) - i))) / list_sum(list_transform(range(1, len(l5) + 1), lambda i: pow(0.9, len(l5) - i)))"),
    "ts_macd": (lambda: c.macd("close", 5, 10), f"{ewm('close', 2 / 6, 'lall')} - {ewm('close', 2 / 11, 'lall')}"),
    "ts_rsi": (lambda: c.rsi("close", 5), f"100 - 100 / (1 + ({ewm('d', 2 / 6, 'lup')}) / nullif({ewm('d', 2 / 6, 'ldown')}, 0))"),
    "ts_bb_middle": (lambda: c.bb_middle("close", 5), _mean),
    "ts_bb_upper": (lambda: c.bb_upper("close", 5), f"{_mean} + {_sd}"),
    "ts_bb_lower": (lambda: c.bb_lower("close", 5), f"{_mean} - {_sd}"),
    "ts_bb_dynamic": (lambda: c.bb_middle_dynamic("close", "volume"), "list_avg(lall[greatest(1, len(lall) - CAST(volume AS INTEGER) + 1):])"),
}


def _query(build: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: events_panel(spark, sf_dir).select("datetime", "instrument", rounded(build()).alias("v"))


def _rolled(**statistics: ro.Rolled) -> Callable[[DataFrame], DataFrame]:
    return lambda panel: ro.rolled(panel, statistics)


def _moves(panel: DataFrame) -> DataFrame:
    """The panel with the rise and the fall of the close since the row before."""
    moved = c.delta("close")
    return panel.withColumns({"rise": F.when(moved.isNotNull(), c.greater(moved, 0.0)), "fall": F.when(moved.isNotNull(), c.greater(-moved, 0.0))})


def _strength(panel: DataFrame) -> DataFrame:
    out = ro.rolled(_moves(panel), {"up": ro.exponential("rise", 2 / 6), "down": ro.exponential("fall", 2 / 6)})
    return out.withColumn("v", 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("up"), F.col("down"))))


def _macd(short: int, long: int) -> Callable[[DataFrame], DataFrame]:
    made = _rolled(short=ro.exponential("close", 2 / (short + 1)), long=ro.exponential("close", 2 / (long + 1)))
    return lambda panel: made(panel).withColumn("v", F.col("short") - F.col("long"))


#: Functions that go through blocks of rows, with their SQL in OPS or BLOCK_SQL: a panel in, column v added.
IN_BLOCKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ts_median": _rolled(v=ro.quantile("close", 5, 0.5)),
    "ts_quantile": _rolled(v=ro.quantile("close", 5, 0.8)),
    "ts_percentile": _rolled(v=ro.quantile("close", 5, 0.3)),
    "ts_mad": _rolled(v=ro.mad("close", 5)),
    "ts_rank": _rolled(v=ro.rank("close", 5)),
    "ts_argmax": _rolled(v=ro.argmax("close", 5)),
    "ts_argmin": _rolled(v=ro.argmin("close", 5)),
    "ts_highday": _rolled(v=ro.highday("close", 5)),
    "ts_lowday": _rolled(v=ro.lowday("close", 5)),
    "ts_ema": _rolled(v=ro.exponential("close", 2 / 6)),
    "ts_sma_weighted": _rolled(v=ro.exponential("close", 2 / 6)),
    "ts_macd": _macd(5, 10),
    "ts_rsi": _strength,
    "ts_bb_dynamic": lambda panel: ro.dynamic_bands(panel, "close", "volume", middle="v"),
    "ts_bb_dynamic_upper": lambda panel: ro.dynamic_bands(panel, "close", "volume", high="v"),
    "ts_bb_dynamic_lower": lambda panel: ro.dynamic_bands(panel, "close", "volume", low="v"),
    "ts_median_120": _rolled(v=ro.quantile("close", 120, 0.5)),
    "ts_mad_120": _rolled(v=ro.mad("close", 120)),
    "ts_rank_20": _rolled(v=ro.rank("close", 20)),
    "ts_argmax_20": _rolled(v=ro.argmax("close", 20)),
    "ts_highday_120": _rolled(v=ro.highday("close", 120)),
    "ts_ema_500": _rolled(v=ro.exponential("close", 2 / 501)),
}
_LAST = "lall[greatest(1, len(lall) - CAST(volume AS INTEGER) + 1):]"
_L20, _L120 = (f"lall[greatest(1, len(lall) - {n - 1}):]" for n in (20, 120))
BLOCK_SQL = {
    "ts_bb_dynamic_upper": f"list_avg({_LAST}) + CASE WHEN len({_LAST}) > 1 THEN list_stddev_samp({_LAST}) END",
    "ts_bb_dynamic_lower": f"list_avg({_LAST}) - CASE WHEN len({_LAST}) > 1 THEN list_stddev_samp({_LAST}) END",
    "ts_median_120": full(120, f"quantile_cont(close, 0.5) {rows(120)}"),
    "ts_mad_120": f"mad(close) {rows(120)}",
    "ts_rank_20": full(20, f"(len(list_filter({_L20}, lambda x: x < close)) + (len(list_filter({_L20}, lambda x: x = close)) + 1) / 2.0) / 20"),
    "ts_argmax_20": full(20, f"CAST(list_position({_L20}, list_max({_L20})) AS DOUBLE)"),
    "ts_highday_120": f"CAST(len({_L120}) - list_position({_L120}, list_max({_L120})) + 1 AS DOUBLE)",
    "ts_ema_500": ewm("close", 2 / 501, "lall"),
}


def _block_query(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(events_panel(spark, sf_dir)).select("datetime", "instrument", rounded(F.col("v")).alias("v"))


QUERIES = {name: _query(build) for name, (build, _) in OPS.items()} | {name: _block_query(build) for name, build in IN_BLOCKS.items()}
ORACLE_SQL = {name: f"WITH {PANEL_SQL}, {STEP}\nSELECT datetime, instrument, {rounded_sql(sql)} AS v FROM r" for name, sql in ({name: sql for name, (_, sql) in OPS.items()} | BLOCK_SQL).items()}
