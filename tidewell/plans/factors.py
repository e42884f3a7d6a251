"""Built-in factor sets, as columns of one select over a panel.

Sets with a parameter `w` take their rolling functions from it: the module of
column functions, or an `operators.windows.Windows`, whose `over` must then give
the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

SMALL = 1e-12


def _ratio(a, b) -> Column:
    return c.divide(a, b)


def _rsv(n: int, w=c) -> Column:
    low = w.ts_min("low", n)
    return _ratio(F.col("close") - low, w.ts_max("high", n) - low + SMALL)


def _ret(k: int, w=c) -> Column:
    return w.ts_pctchange("close", k)


def baseline(n: int = 20) -> dict[str, Column]:
    """The four baseline factors: the day's return, volume against its mean of n rows, amplitude, momentum."""
    close, before = F.col("close"), c.delay("close", 1)
    return {
        "day_return": _ratio(close - F.col("open"), F.col("open")),
        "volume_ratio": _ratio(F.col("volume"), c.ts_mean("volume", n)),
        "amplitude": _ratio(F.col("high") - F.col("low"), before),
        "momentum": _ret(1),
    }


def basic_20() -> dict[str, Column]:
    """The set of twenty price and volume ratios."""
    close, open_, high, low, volume = map(F.col, ("close", "open", "high", "low", "volume"))
    mean, std = c.ts_mean, c.ts_std
    return {
        "ROC0": _ratio(close - open_, open_),
        **{f"ROC{k}": _ret(k) for k in (1, 5, 10, 20)},
        **{f"VRATIO{n}": _ratio(volume, mean("volume", n)) for n in (5, 10)},
        "VSTD5_RATIO": _ratio(std("volume", 5), mean("volume", 5)),
        "RANGE": _ratio(high - low, open_),
        **{f"VOLATILITY{n}": _ratio(std("close", n), close) for n in (5, 10)},
        "RET_VOL5": std(_ret(1), 5),
        **{f"RSV{n}": _rsv(n) for n in (5, 10)},
        "HIGH_RATIO5": _ratio(close, c.ts_max("high", 5)) - 1,
        "LOW_RATIO5": _ratio(close, c.ts_min("low", 5)) - 1,
        "SHADOW_RATIO": _ratio(high - close, close - low + SMALL),
        "BODY_RATIO": _ratio(close - open_, high - low + SMALL),
        **{f"MA_RATIO{a}_{b}": _ratio(mean("close", a), mean("close", b)) - 1 for a, b in ((5, 10), (10, 20))},
    }


def candle() -> dict[str, Column]:
    """Shapes of the day's bar."""
    close, open_, high, low = map(F.col, ("close", "open", "high", "low"))
    span = high - low + SMALL
    top, bottom = F.greatest(open_, close), F.least(open_, close)
    parts = {"KMID": close - open_, "KUP": high - top, "KLOW": bottom - low, "KSFT": 2 * close - high - low}
    out = {"KLEN": _ratio(high - low, open_)}
    for name, x in parts.items():
        out |= {name: _ratio(x, open_), f"{name}2": _ratio(x, span)}
    return out


def rolling_set(windows: tuple[int, ...] = (5, 10, 20, 30, 60), w=c) -> dict[str, Column]:
    """Twenty-nine rolling features for each window."""
    close, volume = F.col("close"), F.col("volume")
    prev, vprev = w.delay("close"), w.delay("volume")
    up, down = c.greater(close - prev, 0.0), c.greater(prev - close, 0.0)
    vup, vdown = c.greater(volume - vprev, 0.0), c.greater(vprev - volume, 0.0)
    logv = F.ln(volume + 1)
    wobble = F.abs(_ret(1, w)) * volume
    move, vmove = F.abs(close - prev), F.abs(volume - vprev)
    rose, fell = c.gt(close, prev), c.lt(close, prev)
    change, logchange = _ratio(close, prev), F.ln(_ratio(volume, vprev) + 1)
    out: dict[str, Column] = {}
    for n in windows:
        moved, vmoved = w.ts_sum(move, n) + SMALL, w.ts_sum(vmove, n) + SMALL
        rises, falls = w.ts_mean(rose, n), w.ts_mean(fell, n)
        high_at, low_at = w.ts_argmax("high", n), w.ts_argmin("low", n)
        mean, total = w.ts_mean("close", n), w.ts_sum
        out |= {
            f"ROC{n}": _ratio(w.delay("close", n), close), f"MA{n}": _ratio(mean, close), f"STD{n}": _ratio(w.ts_std("close", n), close),
            f"BETA{n}": _ratio(w.ts_slope("close", n), close), f"RSQR{n}": w.ts_rsquare("close", n), f"RESI{n}": _ratio(w.ts_resi("close", n), close),
            f"MAX{n}": _ratio(w.ts_max("high", n), close), f"MIN{n}": _ratio(w.ts_min("low", n), close),
            f"QTLU{n}": _ratio(w.ts_quantile("close", n, 0.8), close), f"QTLD{n}": _ratio(w.ts_quantile("close", n, 0.2), close),
            f"RANK{n}": w.ts_rank("close", n), f"RSV{n}": _rsv(n, w),
            f"IMAX{n}": high_at / n, f"IMIN{n}": low_at / n, f"IMXD{n}": (high_at - low_at) / n,
            f"CORR{n}": w.ts_corr("close", logv, n), f"CORD{n}": w.ts_corr(change, logchange, n),
            f"CNTP{n}": rises, f"CNTN{n}": falls, f"CNTD{n}": rises - falls,
            f"SUMP{n}": _ratio(total(up, n), moved), f"SUMN{n}": _ratio(total(down, n), moved), f"SUMD{n}": _ratio(total(up, n) - total(down, n), moved),
            f"VMA{n}": _ratio(w.ts_mean("volume", n), volume + SMALL), f"VSTD{n}": _ratio(w.ts_std("volume", n), volume + SMALL), f"WVMA{n}": _ratio(w.ts_std(wobble, n), w.ts_mean(wobble, n) + SMALL),
            f"VSUMP{n}": _ratio(total(vup, n), vmoved), f"VSUMN{n}": _ratio(total(vdown, n), vmoved), f"VSUMD{n}": _ratio(total(vup, n) - total(vdown, n), vmoved),
        }
    return out


def alpha_158(w=c) -> dict[str, Column]:
    """Nine bar shapes, four prices and the rolling set: 158 columns."""
    prices = {f"{name.upper()}0": _ratio(name, "close") for name in ("open", "high", "low", "vwap")}
    return candle() | prices | rolling_set(w=w)


def alpha_windows(w=c) -> dict[str, Column]:
    """Sixty-six window features: nine for each of five windows, three for each of five more, six bar shapes."""
    close = F.col("close")
    logv = F.ln(F.col("volume") + 1)
    out: dict[str, Column] = {}
    for n in (5, 10, 20, 30, 60, 3, 7, 15, 40, 120):
        out |= {f"ROC{n}": _ratio(w.delay("close", n), close), f"MA{n}": _ratio(w.ts_mean("close", n), close), f"STD{n}": _ratio(w.ts_std("close", n), close)}
    for n in (5, 10, 20, 30, 60):
        out |= {
            f"MAX{n}": _ratio(w.ts_max("high", n), close), f"MIN{n}": _ratio(w.ts_min("low", n), close), f"RSV{n}": _rsv(n, w),
            f"VMA{n}": _ratio(w.ts_mean("volume", n), F.col("volume") + SMALL), f"VSTD{n}": _ratio(w.ts_std("volume", n), F.col("volume") + SMALL), f"CORR{n}": w.ts_corr("close", logv, n),
        }
    bars = candle()
    return out | {k: bars[k] for k in ("KMID", "KLEN", "KMID2", "KUP", "KLOW", "KSFT")}


def with_factors(panel: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """Keys and one column for each factor: one shuffle by instrument, and one by date if a factor looks across it."""
    return panel.select("datetime", "instrument", *(v.alias(k) for k, v in factors.items()))


def unpivoted(values: DataFrame) -> DataFrame:
    """Rows (datetime, instrument, factor, value)."""
    names = [n for n in values.columns if n not in ("datetime", "instrument")]
    return values.unpivot(["datetime", "instrument"], names, "factor", "value")
