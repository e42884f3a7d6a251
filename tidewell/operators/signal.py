"""Signal analytics: information coefficients, risk, screening, correlation, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import average_rank, finite


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary."""
    return finite(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def paired(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def daily_ic(frame: DataFrame, score: str, label: str, by: Sequence[str] = ("datetime",)) -> DataFrame:
    """by..., n, ic, rank_ic: correlations of each date's cross-section, of two rows or more."""
    ranked = paired(frame, score, label).select(*by, F.col(score).alias("_a"), F.col(label).alias("_b"), average_rank(score, tuple(by)).alias("_ra"), average_rank(label, tuple(by)).alias("_rb"))
    daily = ranked.groupBy(*by).agg(F.count("*").alias("n"), safe_corr("_a", "_b").alias("ic"), safe_corr("_ra", "_rb").alias("rank_ic"))
    return daily.where("n >= 2")


def ic_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    def ratio(c: str) -> Column:
        return F.when(F.stddev_samp(c) > 1e-12, F.avg(c) / F.stddev_samp(c)).otherwise(0.0)

    return daily.groupBy(*by).agg(
        F.avg("ic").alias("ic"), ratio("ic").alias("icir"), F.avg("rank_ic").alias("rank_ic"), ratio("rank_ic").alias("rank_icir"), F.sum("n").alias("aligned_rows"), F.count("*").alias("active_days"), F.avg("n").alias("mean_cross_section")
    )


def risk(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """annualized_return, information_ratio, max_drawdown, calmar_ratio of column excess by date, within `by`.

    238 days make a year; the drawdown is that of the summed series from a peak of at least 0.
    """
    groups = list(by)
    so_far = Window.partitionBy(*groups).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    path = returns.where("excess is not null").withColumn("_sum", F.sum("excess").over(so_far))
    path = path.withColumn("_peak", F.greatest(F.max("_sum").over(so_far), F.lit(0.0)))
    out = path.groupBy(*groups).agg(F.avg("excess").alias("_m"), F.stddev_samp("excess").alias("_s"), F.least(F.min(F.col("_sum") - F.col("_peak")), F.lit(0.0)).alias("max_drawdown"))
    year = 238.0
    return out.select(
        *groups,
        (F.col("_m") * year).alias("annualized_return"),
        (F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s")).otherwise(0.0) * year**0.5).alias("information_ratio"),
        "max_drawdown",
        F.when(F.abs("max_drawdown") > 1e-12, F.col("_m") * year / F.abs("max_drawdown")).otherwise(0.0).alias("calmar_ratio"),
    )


def pre_backtest_screen(long: DataFrame, limits: dict[str, float]) -> DataFrame:
    """factor, its seven screening metrics and the reasons it fails, from rows (factor, datetime, instrument, value)."""
    rows = long.withColumn("_v", finite("value"))
    level = rows.groupBy("factor").agg(F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"))  # a row for each factor
    rows = rows.join(level, "factor").withColumn("_z", F.abs(F.try_divide(F.col("_v") - F.col("_m"), F.col("_s"))))
    daily = rows.groupBy("factor", "datetime").agg(F.count("_v").alias("d_n"), F.count("*").alias("d_rows"), (F.min("_v") == F.max("_v")).alias("d_same"))
    days = daily.groupBy("factor").agg(F.avg((F.col("d_n") > 0).cast("double")).alias("active_ratio"), F.avg(F.coalesce("d_same", F.lit(True)).cast("double")).alias("constant_ratio"), F.avg(F.col("d_n") / F.col("d_rows")).alias("coverage"))
    whole = rows.groupBy("factor").agg(F.avg(F.col("_v").isNotNull().cast("double")).alias("valid_ratio"), F.avg(F.col("_v").isNull().cast("double")).alias("nan_ratio"), F.countDistinct("_v").alias("n_unique"), F.avg(F.coalesce(F.col("_z") > 8, F.lit(False)).cast("double")).alias("extreme_ratio"))
    out = whole.join(days, "factor")
    fails = [F.when(F.col(k[4:]) < v, F.lit(k[4:])) if k.startswith("min_") else F.when(F.col(k[4:]) > v, F.lit(k[4:])) for k, v in limits.items()]
    return out.withColumn("reasons", F.array_join(F.array_compact(F.array(*fails)), ","))


def quantile_buckets(frame: DataFrame, score: str, n: int, by: str = "datetime") -> DataFrame:
    """bucket 0 to n - 1 by rank of the score within a date, ties by instrument."""
    w = Window.partitionBy(by)
    rank = F.row_number().over(w.orderBy(score, "instrument")) - 1
    return frame.where(F.col(score).isNotNull()).withColumn("bucket", F.least(F.lit(n - 1), F.floor(rank * n / F.count("*").over(w))).cast("int"))


def turnover(frame: DataFrame, score: str, n: int = 5) -> DataFrame:
    """datetime, turnover: 1 less the Jaccard of successive sets of the top bucket."""
    top = quantile_buckets(frame, score, n).where(F.col("bucket") == n - 1).groupBy("datetime").agg(F.collect_set("instrument").alias("s"))
    before = F.lag("s").over(Window.orderBy("datetime"))  # a row for each date
    return top.withColumn("b", before).where("b is not null").select("datetime", (1 - F.size(F.array_intersect("s", "b")) / F.size(F.array_union("s", "b"))).alias("turnover"))


def regimes(market: DataFrame, n: int = 20) -> DataFrame:
    """date, regime: bull, bear or sideways, and high_vol or low_vol, from rolling return and deviation of market_return."""
    w = Window.orderBy("date").rowsBetween(1 - n, 0)  # a row for each date
    rolled = market.withColumn("_n", F.count("market_return").over(w)).withColumns({"trend": F.when(F.col("_n") >= n, F.avg("market_return").over(w)), "vol": F.when(F.col("_n") >= n, F.stddev_pop("market_return").over(w))})
    cut = rolled.agg(F.percentile("trend", F.array(F.lit(0.3), F.lit(0.7))).alias("t"), F.percentile("vol", F.lit(0.7)).alias("v")).first()
    if cut.t is None:
        return rolled.select("date", F.lit(None).cast("string").alias("regime"))
    trend = F.when(F.col("trend") >= cut.t[1], "bull").when(F.col("trend") <= cut.t[0], "bear").otherwise("sideways")
    return rolled.where("trend is not null").select("date", F.concat_ws("_", trend, F.when(F.col("vol") >= cut.v, "high_vol").otherwise("low_vol")).alias("regime"))


def ic_trend(daily: DataFrame, windows: dict[int, float], by: str = "factor", value: str = "ic") -> DataFrame:
    """by, trend: weighted mean of the slopes over the last rows of each window size, over the finite ones."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("date")))
    rows = daily.withColumn("_b", back).withColumn("_t", -F.col("_b").cast("double"))
    slopes = rows.groupBy(by).agg(*(F.when(F.count(F.when(F.col("_b") <= n, F.col(value))) >= n, F.regr_slope(F.when(F.col("_b") <= n, F.col(value)), F.col("_t"))).alias(f"s{n}") for n in windows))
    total = sum((F.coalesce(F.col(f"s{n}") * w, F.lit(0.0)) for n, w in windows.items()), F.lit(0.0))
    weight = sum((F.when(F.col(f"s{n}").isNotNull(), w).otherwise(0.0) for n, w in windows.items()), F.lit(0.0))
    return slopes.select(by, F.try_divide(total, weight).alias("trend"))


def winsorized(frame: DataFrame, value: str, k: float = 3.0, by: Sequence[str] = ("datetime",)) -> DataFrame:
    """value clipped to median +- k median absolute deviations of its group."""
    w = Window.partitionBy(*by)
    out = frame.withColumn("_m", F.median(value).over(w)).withColumn("_d", F.median(F.abs(F.col(value) - F.col("_m"))).over(w))
    return out.withColumn(value, F.greatest(F.least(F.col(value), F.col("_m") + k * F.col("_d")), F.col("_m") - k * F.col("_d"))).drop("_m", "_d")


def percentile_clipped(frame: DataFrame, value: str, low: float = 0.01, high: float = 0.99, by: Sequence[str] = ("datetime",)) -> DataFrame:
    w = Window.partitionBy(*by)
    out = frame.withColumn("_q", F.percentile(value, F.array(F.lit(low), F.lit(high))).over(w))
    return out.withColumn(value, F.greatest(F.least(F.col(value), F.col("_q")[1]), F.col("_q")[0])).drop("_q")


# Weights of the health score's dimensions, and their sigmoids (k, x0).
HEALTH_WEIGHTS = {"prediction_power": 25, "stability": 20, "oos_ability": 15, "independence": 15, "tradability": 10, "recent_performance": 10, "signal_persistence": 5}


def sigmoid_score(x: Column, k: float, x0: float) -> Column:
    power = F.greatest(F.least(-k * (x - x0), F.lit(700.0)), F.lit(-700.0))
    return F.when(x.isNotNull(), 100 / (1 + F.exp(power)))


def health(frame: DataFrame, dimensions: dict[str, Column], weights: dict[str, int] = HEALTH_WEIGHTS) -> DataFrame:
    """frame with health_score and health_confidence; a missing dimension counts 0 and lowers the confidence."""
    total = float(sum(weights.values()))
    score = sum((F.coalesce(dimensions[d], F.lit(0.0)) * w for d, w in weights.items()), F.lit(0.0)) / total
    known = sum((F.when(dimensions[d].isNotNull(), F.lit(float(w))).otherwise(0.0) for d, w in weights.items()), F.lit(0.0)) / total
    return frame.withColumns({"health_score": score, "health_confidence": known})


def latest_events(log: DataFrame, key: str, order: Sequence[str], op: str = "op") -> DataFrame:
    """Effective rows of an event log: the newest of each key, unless that is a delete."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(o) for o in order)))
    return log.withColumn("_r", rank).where(f"_r = 1 and {op} <> 'delete'").drop("_r")


def top_per_group(frame: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def expression_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z_0-9]+)"), F.lit(1)))


def token_jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def expression_skeleton(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), r"\d+(\.\d+)?", "N")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda t, v: t + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def chunks(docs: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """Pieces of `size` characters, each starting size - overlap after the one before; column chunk_no from 0."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return docs.select("*", F.posexplode(F.transform(starts, lambda s: F.substr(F.col(text), s + 1, F.lit(size)))).alias("chunk_no", "chunk"))
