"""Evaluation of factors: out-of-sample splits, horizons, regimes, gates, clusters, tiers and scores.

Frames are long, a row for each (factor, datetime, instrument), or summaries
with a row for each factor.  Per-factor work is by aggregates that Spark sums
up before the shuffle; windows run over a factor's dates, never over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite
from ..storage import stored
from .selection import medians_and_spreads
from .signal import daily_ic, safe_corr

TRADING_DAYS = 252.0


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def out_of_sample(daily: DataFrame, recent: int = 250, by: str = "factor", value: str = "rank_ic") -> DataFrame:
    """by, mean coefficients of the first 60 %, next 20 % and last 20 % of the dates and of the recent ones, yearly figures and decay.

    An empty part counts 0; without a last part, the last date is it.
    """
    w = Window.partitionBy(by)
    rows = daily.where(F.col(value).isNotNull()).select(by, "datetime", F.col(value).alias("_v")).withColumns({"_i": F.row_number().over(w.orderBy("datetime")) - 1, "_n": F.count("*").over(w)})
    first = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.6))
    second = F.when(F.col("_n") > 2, F.greatest(first + 1, F.floor(F.col("_n") * 0.8))).otherwise(F.col("_n"))
    rows = rows.withColumns({"_a": first, "_b": second})
    test = (F.col("_i") >= F.col("_b")) | (F.col("_b") >= F.col("_n")) & (F.col("_i") == F.col("_n") - 1)

    def mean(which: Column, name: str) -> Column:
        return _or_zero(F.avg(F.when(which, F.col("_v")))).alias(name)

    parts = rows.groupBy(by).agg(
        mean(F.col("_i") < F.col("_a"), "rank_ic_train"), mean((F.col("_i") >= F.col("_a")) & (F.col("_i") < F.col("_b")), "rank_ic_valid"), mean(test, "rank_ic_test"), mean(F.col("_i") >= F.col("_n") - recent, "rank_ic_recent")
    )
    years = rows.groupBy(by, F.year("datetime").alias("_y")).agg(F.avg("_v").alias("_m")).groupBy(by)
    years = years.agg(F.avg((F.col("_m") > 0).cast("double")).alias("positive_year_ratio"), F.min("_m").alias("worst_year_rank_ic"), F.stddev_pop("_m").alias("ic_std_by_year"))
    return parts.join(years, by).withColumn("ic_decay", F.col("rank_ic_test") / (F.abs("rank_ic_train") + 1e-12))


def multi_horizon_ic(frame: DataFrame, score: str, horizons: Sequence[int], prefix: str = "return_t_plus_") -> DataFrame:
    """horizon, datetime, n, ic, rank_ic from one unpivot of the return columns."""
    names = [f"{prefix}{h}" for h in horizons]
    long = frame.select("datetime", "instrument", score, *names).unpivot(["datetime", "instrument", score], names, "horizon", "_return")
    return daily_ic(long.withColumn("horizon", F.substring("horizon", len(prefix) + 1, 9).cast("int")), score, "_return", ("horizon", "datetime"))


def annualised_icir(value: str) -> Column:
    """Mean over deviation of daily coefficients, for a year; null without deviation."""
    return F.try_divide(F.avg(value), F.when(F.stddev_samp(value) > 1e-12, F.stddev_samp(value))) * TRADING_DAYS**0.5


def decay(profile: DataFrame, by: str = "factor", value: str = "ic") -> DataFrame:
    """by, optimal_horizon, half_life_days, decay_speed from rows (by, horizon, value).

    The optimal horizon has the largest absolute value, the smallest of equal
    ones.  The half-life is where, going up, the line between neighbours first
    falls through half of it; 0.5 if the first is below, 30 if none falls.
    """
    w = Window.partitionBy(by)
    rows = profile.where(finite(value).isNotNull()).select(by, "horizon", F.abs(value).alias("_v"))
    rows = rows.withColumns({"_top": F.max("_v").over(w), "_next": F.lead("_v").over(w.orderBy("horizon")), "_then": F.lead("horizon").over(w.orderBy("horizon"))})
    half = F.col("_top") / 2
    falls = (F.col("_v") >= half) & (half >= F.col("_next"))
    at = F.when(F.col("_v") == F.col("_next"), F.col("_then").cast("double")).otherwise(F.col("horizon") + (half - F.col("_v")) / (F.col("_next") - F.col("_v")) * (F.col("_then") - F.col("horizon")))
    out = rows.groupBy(by).agg(F.min(F.when(F.col("_v") == F.col("_top"), F.col("horizon"))).alias("optimal_horizon"), F.min_by("_v", "horizon").alias("_first"), F.max("_top").alias("_top"), F.min(F.when(falls, F.struct(F.col("horizon"), at.alias("at")))).alias("_fall"))
    life = F.when(F.col("_first") < F.col("_top") / 2, 0.5).otherwise(F.coalesce("_fall.at", F.lit(30.0)))
    return out.select(by, "optimal_horizon", life.alias("half_life_days")).withColumn("decay_speed", F.when(F.col("half_life_days") < 3, "fast").when(F.col("half_life_days") <= 10, "medium").otherwise("slow"))


def regime_ic(daily: DataFrame, regimes: DataFrame, by: str = "factor", value: str = "ic") -> DataFrame:
    """by, regime, ic_mean, icir, n_days, and whether the regime is the factor's best or worst; ties by name."""
    rows = daily.where(finite(value).isNotNull()).join(regimes.where("regime is not null"), "date")
    out = rows.groupBy(by, "regime").agg(F.avg(value).alias("ic_mean"), annualised_icir(value).alias("icir"), F.count("*").alias("n_days"))
    w = Window.partitionBy(by)
    return out.withColumns({"is_best": F.row_number().over(w.orderBy(F.desc("ic_mean"), "regime")) == 1, "is_worst": F.row_number().over(w.orderBy("ic_mean", "regime")) == 1})


def significant_decline(daily: DataFrame, window: int, drop: float = 0.2, by: str = "factor", value: str = "ic") -> DataFrame:
    """by, before, recent, declined: mean of the last `window` dates against that of the `window` before them."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("date")))
    rows = daily.where(finite(value).isNotNull()).withColumn("_b", back).where(F.col("_b") <= 2 * window)
    out = rows.groupBy(by).agg(F.count("*").alias("_n"), F.avg(F.when(F.col("_b") <= window, F.col(value))).alias("recent"), F.avg(F.when(F.col("_b") > window, F.col(value))).alias("before"))
    relative = F.try_divide(F.col("before") - F.col("recent"), F.abs("before"))
    return out.select(by, "before", "recent", ((F.col("_n") >= 2 * window) & F.coalesce(relative >= drop, F.lit(False))).alias("declined"))


def last_value_jump(daily: DataFrame, limit: float = 5.0, by: str = "factor", value: str = "value") -> DataFrame:
    """by, z, jumped: distance of the last date's value from the dates before it, in their population deviations."""
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("date"))) == 1
    rows = daily.where(finite(value).isNotNull()).withColumn("_last", last)
    past = F.when(~F.col("_last"), F.col(value))
    out = rows.groupBy(by).agg(F.max(F.when(F.col("_last"), F.col(value))).alias("_v"), F.avg(past).alias("_m"), F.stddev_pop(past).alias("_s"))
    z = F.try_divide(F.abs(F.col("_v") - F.col("_m")), F.when(F.col("_s") > 0, F.col("_s")))
    return out.select(by, z.alias("z"), F.coalesce(z > limit, F.lit(False)).alias("jumped"))


# Limits of the data-quality gate, what a failed check leads to, and the order of results, worst first.
QUALITY_LIMITS = {"missing_rate": 0.40, "coverage_rate": 0.60, "min_cross_section_count": 500, "min_cross_section_pass_ratio": 0.90, "extreme_value_ratio": 0.05, "extreme_value_mads": 5.0, "single_day_jump": 5.0, "suspension_ratio": 0.30, "future_function": 0.50, "future_days": 60}
QUALITY_FAILURES = {
    "missing_rate": "reject",
    "coverage_rate": "watchlist",
    "min_cross_section_count": "reject",
    "extreme_value_ratio": "re_winsorize",
    "single_day_jump": "watchlist",
    "future_function": "blacklist",
    "pit_validation": "blacklist",
    "suspension_ratio": "watchlist",
    "st_or_delisted": "watchlist",
}
RESULT_ORDER = ["blacklist", "reject", "watchlist", "re_winsorize", "pass"]


def _with_missing_flags(long: DataFrame) -> DataFrame:
    absent = {"is_suspended": F.lit(False), "is_st": F.lit(False), "is_delisted": F.lit(False), "pit_valid": F.lit(True), "factor_type": F.lit("")}
    return long.withColumns({k: v for k, v in absent.items() if k not in long.columns})


def data_quality_gate(long: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """factor, the value of each check, gate_result and reason, from rows (factor, datetime, instrument, value, return_t_plus_*).

    All nine checks run.  Flags is_suspended, is_st, is_delisted and pit_valid
    (of factor_type 'financial') count where the frame has them.
    """
    at = QUALITY_LIMITS | (limits or {})
    rows = _with_missing_flags(long).withColumn("_v", finite("value"))
    returns = [c for c in long.columns if c.startswith("return_t_plus_")]
    known = F.col("_v").isNotNull()
    spread = stored(medians_and_spreads(rows, ["factor"], "_v"), "spreads")
    far = F.abs(F.col("_v") - F.col("_med")) > at["extreme_value_mads"] * F.col("_mad")
    whole = rows.join(spread, "factor", "left").groupBy("factor").agg(
        F.avg((~known).cast("double")).alias("missing_rate"),
        F.avg(known.cast("double")).alias("coverage_rate"),
        _or_zero(F.avg(F.when(known, far.cast("double")))).alias("extreme_value_ratio"),
        F.avg(F.coalesce("is_suspended", F.lit(False)).cast("double")).alias("suspension_ratio"),
        F.max(F.coalesce(F.col("is_st") | F.col("is_delisted"), F.lit(False)).cast("double")).alias("st_or_delisted"),
        F.min(F.when(F.col("factor_type") == "financial", F.coalesce("pit_valid", F.lit(False))).otherwise(True).cast("double")).alias("pit_validation"),
    )
    daily = rows.where(known).groupBy("factor", F.col("datetime").alias("date")).agg(F.count("*").alias("_n"), F.avg("_v").alias("value"))
    days = daily.groupBy("factor").agg(F.avg((F.col("_n") >= at["min_cross_section_count"]).cast("double")).alias("min_cross_section_count"))
    jump = last_value_jump(daily, at["single_day_jump"]).select("factor", F.col("jumped").cast("double").alias("single_day_jump"))
    out = whole.join(days, "factor", "left").join(jump, "factor", "left").na.fill(0.0, ["min_cross_section_count", "single_day_jump"])
    if returns:
        dates = rows.select("factor", "datetime").distinct()
        recent = dates.withColumn("_r", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("datetime")))).where(F.col("_r") <= at["future_days"]).drop("_r")
        late = rows.join(recent, ["factor", "datetime"]).select("factor", "datetime", "instrument", "_v", *returns).unpivot(["factor", "datetime", "instrument", "_v"], returns, "_h", "_return")
        seen = daily_ic(late, "_v", "_return", ("factor", "_h", "datetime")).groupBy("factor").agg(F.max(F.abs("rank_ic")).alias("future_function"))
        out = out.join(seen, "factor", "left").na.fill(0.0, ["future_function"])
    else:
        out = out.withColumn("future_function", F.lit(0.0))
    passed = {
        "missing_rate": F.col("missing_rate") <= at["missing_rate"],
        "coverage_rate": F.col("coverage_rate") >= at["coverage_rate"],
        "min_cross_section_count": F.col("min_cross_section_count") >= at["min_cross_section_pass_ratio"],
        "extreme_value_ratio": F.col("extreme_value_ratio") <= at["extreme_value_ratio"],
        "single_day_jump": F.col("single_day_jump") == 0,
        "future_function": F.col("future_function") <= at["future_function"],
        "pit_validation": F.col("pit_validation") == 1,
        "suspension_ratio": F.col("suspension_ratio") <= at["suspension_ratio"],
        "st_or_delisted": F.col("st_or_delisted") == 0,
    }
    return _resolved(out, passed)


def _resolved(frame: DataFrame, passed: dict[str, Column]) -> DataFrame:
    """frame with gate_result, the worst that a failed check leads to, and reason, the first check that leads there."""
    place = {r: i for i, r in enumerate(RESULT_ORDER)}
    worst = F.least(*(F.when(~ok, place[QUALITY_FAILURES.get(c, "blacklist")]).otherwise(place["pass"]) for c, ok in passed.items()), F.lit(place["pass"]))
    names = F.array(*map(F.lit, RESULT_ORDER))
    out = frame.withColumn("gate_result", F.element_at(names, worst + 1))
    reason = F.coalesce(*(F.when(~ok & (F.col("gate_result") == QUALITY_FAILURES.get(c, "blacklist")), F.lit(f"{c} failed")) for c, ok in passed.items()), F.lit("all checks passed"))
    return out.withColumn("reason", reason)


def pool_correlations(candidates: DataFrame, pool: DataFrame, by: str = "rank") -> DataFrame:
    """factor, pool_factor, datetime, correlation of the cross-sections that a candidate and a pool factor share (by ranks or values).

    One equi-join of cells; the pool is small against the cells it is joined by.
    """
    a = candidates.where(finite("value").isNotNull()).select("datetime", "instrument", "factor", F.col("value").alias("_x"))
    b = pool.where(finite("value").isNotNull()).select("datetime", "instrument", F.col("factor").alias("pool_factor"), F.col("value").alias("_y"))
    both = a.join(b, ["datetime", "instrument"])
    keys = ["factor", "pool_factor", "datetime"]
    if by == "rank":
        return daily_ic(both, "_x", "_y", tuple(keys)).select(*keys, F.col("rank_ic").alias("correlation")).where("correlation is not null")
    return both.groupBy(*keys).agg(F.count("*").alias("_n"), safe_corr("_x", "_y").alias("correlation")).where("_n >= 2 and correlation is not null").drop("_n")


def redundancy_gate(correlations: DataFrame, similarity: DataFrame | None = None, most_similar: float = 0.85, most_correlated: float = 0.85) -> DataFrame:
    """factor, max_abs_corr, nearest_factor_id, gate_result: blacklist at either limit; similarity has rows (factor, expression_similarity)."""
    out = correlations.groupBy("factor").agg(F.max(F.struct(F.abs("correlation").alias("c"), F.col("pool_factor").alias("f"))).alias("_m")).select("factor", F.col("_m.c").alias("max_abs_corr"), F.col("_m.f").alias("nearest_factor_id"))
    out = out.join(similarity, "factor", "full_outer") if similarity is not None else out.withColumn("expression_similarity", F.lit(0.0))
    bad = (_or_zero(F.col("expression_similarity")) >= most_similar) | (_or_zero(F.col("max_abs_corr")) >= most_correlated)
    return out.withColumn("gate_result", F.when(bad, "blacklist").otherwise("pass"))


def redundancy_clusters(correlations: DataFrame, clusters: DataFrame, limit: float = 0.70) -> DataFrame:
    """factor, nearest_factor_id, mean_abs_corr, cluster_id, action: joins the nearest pool factor's cluster at the limit, else founds its own.

    clusters has rows (pool_factor, cluster_id); a pool factor without one has
    a cluster of its own name.  Nearest: largest mean absolute correlation, then
    largest mean, then smallest name.
    """
    means = correlations.groupBy("factor", "pool_factor").agg(F.avg(F.abs("correlation")).alias("mean_abs_corr"), F.avg("correlation").alias("_m"))
    order = Window.partitionBy("factor").orderBy(F.desc("mean_abs_corr"), F.desc("_m"), "pool_factor")
    best = means.withColumn("_r", F.row_number().over(order)).where("_r = 1").join(clusters, "pool_factor", "left")
    joins = F.col("mean_abs_corr") >= limit
    theirs = F.coalesce("cluster_id", F.concat(F.lit("cluster_"), "pool_factor"))
    return best.select("factor", F.col("pool_factor").alias("nearest_factor_id"), "mean_abs_corr", F.when(joins, theirs).otherwise(F.concat(F.lit("cluster_"), "factor")).alias("cluster_id"), F.when(joins, "join_existing_cluster").otherwise("new_cluster").alias("action"))


def after_cost_sharpe(daily: DataFrame, by: str = "factor", fee: float = 0.0015) -> DataFrame:
    """by, sharpe of rows (by, ret, turnover), both sides of a turnover paying the fee; null without deviation."""
    return daily.withColumn("_net", F.col("ret") - 2 * fee * F.col("turnover")).groupBy(by).agg(annualised_icir("_net").alias("sharpe"))


# Sigmoids (k, x0) of the health score's dimensions.
HEALTH_SIGMOIDS = {"prediction_power": (50.0, 0.03), "stability": (10.0, 0.5), "oos_ability": (50.0, 0.02), "independence": (-20.0, 0.85), "tradability": (5.0, 1.0), "recent_performance": (10.0, 0.0), "signal_persistence": (0.5, 10.0)}


def health_dimensions(inputs: dict[str, Column]) -> dict[str, Column]:
    """The seven dimension scores from columns ic, icir, oos_ic, max_abs_corr, sharpe_after_cost, trend_slope, half_life."""
    from .signal import sigmoid_score

    of = {"prediction_power": F.abs(inputs["ic"]), "stability": inputs["icir"], "oos_ability": F.abs(inputs["oos_ic"]), "independence": F.abs(inputs["max_abs_corr"]), "tradability": inputs["sharpe_after_cost"], "recent_performance": inputs["trend_slope"], "signal_persistence": inputs["half_life"]}
    return {d: sigmoid_score(finite(x), *HEALTH_SIGMOIDS[d]) for d, x in of.items()}


# Days of the history that decay is read from, of its later part and of its end, and the ratio of means that is decay.
DECAY_DAYS = (120, 60, 20)
DECAY_RATIO = 0.8


def recent_decay(daily: DataFrame, by: str = "factor", value: str = "ic", days: tuple[int, int, int] = DECAY_DAYS) -> DataFrame:
    """by, recent_decay from the last days of rows (by, date, value): the later part's mean is at most 0.8 of the earlier's, or the end's at most 0.

    False with fewer rows than the first of the days, with an earlier mean of 0,
    and where a value that a mean needs is null, NaN or infinite.  Rows of one
    date count each; only the last days of a key take part.
    """
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("date"), F.desc(value)))
    last = daily.select(by, finite(value).alias("_v"), back.alias("_b")).where(F.col("_b") <= days[0])

    def mean(rows: Column) -> Column:
        return F.when(F.count_if(rows & F.col("_v").isNull()) == 0, F.avg(F.when(rows, F.col("_v"))))

    later = F.col("_b") <= days[1]
    sums = last.groupBy(by).agg(F.count("*").alias("_n"), mean(~later).alias("_early"), mean(later).alias("_late"), mean(F.col("_b") <= days[2]).alias("_end"))
    whole = (F.col("_n") == days[0]) & F.col("_early").isNotNull() & F.col("_late").isNotNull() & F.col("_end").isNotNull() & (F.col("_early") != 0)
    fallen = (F.try_divide("_late", "_early") <= DECAY_RATIO) | (F.col("_end") <= 0)
    return sums.select(by, F.coalesce(whole & fallen, F.lit(False)).alias("recent_decay"))


def tiers(scores: DataFrame, min_confidence: float = 0.60, core: float = 80.0, satellite: float = 60.0, watch: float = 40.0, max_corr: float = 0.85, min_oos_ic: float = 0.02, min_oos_icir: float = 0.30) -> DataFrame:
    """scores with tier (A to D), ops_status, weight_cap and reasons.

    Columns: health_score, health_confidence, oos_ic, oos_icir, max_abs_corr,
    and booleans pit_failed, severe_data_issue, after_cost_effective,
    marginal_contribution, regime_effective, recent_decay; a null flag says nothing.
    """

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    health = F.col("health_score")
    hard = {"health score below retired threshold": health < watch, "pit failed": flag("pit_failed"), "severe data issue": flag("severe_data_issue"), "after-cost ineffective": F.coalesce(~F.col("after_cost_effective"), F.lit(False))}
    oos = (_or_zero(F.col("oos_ic")) > min_oos_ic) & (_or_zero(F.col("oos_icir")) > min_oos_icir)
    blocks = {"oos failed": ~oos, "correlation too high": F.coalesce(F.col("max_abs_corr") >= max_corr, F.lit(False)), "recent decay detected": flag("recent_decay")}

    def listed(reasons: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())))

    sure = F.coalesce(F.col("health_confidence") >= min_confidence, F.lit(False))
    out = scores.withColumns({"_hard": listed(hard), "_blocks": listed(blocks)})
    backed = flag("marginal_contribution") | flag("regime_effective") | (health >= core)
    cases = [
        (F.size("_hard") > 0, "D", "retired", F.col("_hard")),
        ((health >= core) & sure & (F.size("_blocks") == 0), "A", "core", F.array(F.lit("core rules passed"))),
        ((health >= core) & sure, "B", "satellite", F.col("_blocks")),
        ((health >= satellite) & sure & backed, "B", "satellite", F.array(F.lit("satellite rules passed"))),
        ((health >= satellite) & sure, "C", "candidate", F.array(F.lit("missing marginal contribution evidence"))),
        (F.lit(True), "C", "watchlist", F.array_compact(F.array(F.lit("candidate score band"), F.when(~sure, F.lit("confidence below threshold"))))),
    ]
    picked = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(t).alias("tier"), F.lit(s).alias("status"), r.alias("reasons"))) for c, t, s, r in cases))
    out = out.withColumn("_case", picked)
    cap = F.when(F.col("tier") == "A", 1.0).when(F.col("tier") == "B", 0.5).otherwise(0.0)
    return out.withColumns({"tier": F.col("_case.tier"), "ops_status": F.col("_case.status"), "reasons": F.array_join("_case.reasons", "; ")}).withColumn("weight_cap", cap).drop("_hard", "_blocks", "_case")


# The sources that make up the foundation.
FOUNDATION_SOURCES = ["formula", "manual", "mined"]


def foundation_index(registry: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., foundation_health_index (weighted by confidence, 0 without weight), foundation_factor_count, excluded_factor_count."""
    inside = F.lower("data_source_type").isin(FOUNDATION_SOURCES)
    usable = inside & finite("health_score").isNotNull() & (finite("health_confidence") > 0)
    total = F.sum(F.when(usable, F.col("health_confidence")))
    index = _or_zero(F.try_divide(F.sum(F.when(usable, F.col("health_score") * F.col("health_confidence"))), total))
    return registry.groupBy(*by).agg(index.alias("foundation_health_index"), F.count_if(inside).alias("foundation_factor_count"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("excluded_factor_count"))


def index_drops(history: DataFrame, one_step: float = 10.0, five_steps: float = 15.0, by: str = "series", value: str = "index") -> DataFrame:
    """history with drop and reason: absolute_drop against the row before, else five_day_cumulative_drop against the fifth before."""
    w = Window.partitionBy(by).orderBy("date")
    rows = history.where(finite(value).isNotNull()).withColumns({"_1": F.lag(value).over(w) - F.col(value), "_5": F.lag(value, 5).over(w) - F.col(value)})
    reason = F.when(F.col("_1") >= one_step, "absolute_drop").when(F.col("_5") >= five_steps, "five_day_cumulative_drop").otherwise("")
    return rows.withColumn("reason", reason).withColumn("drop", F.when(F.col("reason") == "absolute_drop", F.col("_1")).when(F.col("reason") != "", F.col("_5")).otherwise(0.0)).drop("_1", "_5")


def model_contribution(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """factor and the change of each metric when it is added to the baseline (added_*) and dropped from the full set (drop_one_*).

    runs: rows (kind, factor, metrics...), kind being baseline, full, candidate_added or drop_one.
    """
    def of(kind: str, prefix: str) -> DataFrame:
        return runs.where(F.col("kind") == kind).select(*(["factor"] if kind in ("candidate_added", "drop_one") else []), *(F.col(m).alias(f"{prefix}{m}") for m in metrics))

    # baseline and full are a row each, checked here
    ends = {kind: of(kind, "").limit(2).collect() for kind in ("baseline", "full")}
    if any(len(r) != 1 for r in ends.values()):
        raise ValueError("one baseline run and one full run are wanted")
    both = of("candidate_added", "_a_").join(of("drop_one", "_d_"), "factor", "full_outer")
    added = [(F.col(f"_a_{m}") - F.lit(ends["baseline"][0][m])).alias(f"added_{m}") for m in metrics]
    dropped = [(F.lit(ends["full"][0][m]) - F.col(f"_d_{m}")).alias(f"drop_one_{m}") for m in metrics]
    return both.select("factor", *added, *dropped)


# Shares of the rank by influence and least changes of the coefficient, for deep-learned sources and others.
LEARNED_SOURCES = ["dl-feature", "dl_feature", "ts-gru", "ts_gru"]
DOWNGRADE_LIMITS = {"learned": (0.50, 0.003), "other": (0.80, 0.002)}


def downgrades(rows: DataFrame) -> DataFrame:
    """factor, new_status, reason of rows (factor, data_source_type, shap_rank_pct, drop_one_ic_change) that are to go down."""
    learned = F.coalesce(F.lower("data_source_type").isin(LEARNED_SOURCES), F.lit(False))
    rank, change = _or_zero(F.col("shap_rank_pct")), _or_zero(F.col("drop_one_ic_change"))

    def fails(kind: str) -> Column:
        return (rank > DOWNGRADE_LIMITS[kind][0]) & (change < DOWNGRADE_LIMITS[kind][1])

    reason = F.when(learned & fails("learned"), "ts-gru contribution failed").when(~learned & fails("other"), "low shap rank and drop-one IC below threshold")
    return rows.withColumn("reason", reason).where("reason is not null").select("factor", F.lit("watchlist").alias("new_status"), "reason")


def period_summary(periods: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("factor",)) -> DataFrame:
    """by..., counts of periods, mean and population deviation of each metric over successful ones, worst drawdown, win rate, stability score.

    periods: rows (by..., status, metrics..., ic, rank_ic, annualized_return, information_ratio, max_drawdown).
    """
    good = F.col("status") == "success"

    def over(c: Column) -> Column:
        return F.when(good, c)

    signs = [F.col(c) for c in ("ic", "rank_ic", "annualized_return")]
    known = sum((c.isNotNull().cast("double") for c in signs), F.lit(0.0))
    wins = sum((F.coalesce(c > 0, F.lit(False)).cast("double") for c in signs), F.lit(0.0))
    every = [*dict.fromkeys([*metrics, "ic", "rank_ic", "information_ratio"])]
    out = periods.groupBy(*by).agg(
        F.count("*").alias("period_count"), F.count_if(good).alias("success_count"), *(F.avg(over(F.col(m))).alias(f"{m}_mean") for m in every), *(F.stddev_pop(over(F.col(m))).alias(f"{m}_std") for m in every),
        F.min(over(F.col("max_drawdown"))).alias("max_drawdown_worst"), F.avg(over(F.try_divide(wins, known))).alias("win_rate_mean"),
    )
    out = out.withColumn("failure_count", F.col("period_count") - F.col("success_count"))
    raw = 0.35 * F.greatest(_or_zero(F.col("ic_mean")), F.lit(0.0)) + 0.35 * F.greatest(_or_zero(F.col("rank_ic_mean")), F.lit(0.0)) + 0.3 * F.least(F.greatest(_or_zero(F.col("information_ratio_mean")), F.lit(0.0)), F.lit(1.5)) / 1.5
    unsteady = F.least(1.5 * _or_zero(F.col("ic_std")) + 1.5 * _or_zero(F.col("rank_ic_std")), F.lit(0.6))
    failed = F.least(F.col("failure_count") * 0.2, F.lit(0.8))
    score = F.greatest(F.least(raw - unsteady - failed + 0.5, F.lit(1.0)), F.lit(0.0))
    return out.withColumn("stability_score", F.when(F.col("success_count") == 0, 0.0).otherwise(F.round(score, 4)))


def judged_periods(periods: DataFrame, min_ic: float = 0.0, min_rank_ic: float = 0.0, min_pass: int = 1, all_must_pass: bool = True, by: Sequence[str] = ("factor",)) -> DataFrame:
    """by..., passing, failing, overall_pass: a period passes with both coefficients strictly above their limits."""
    ok = F.coalesce((F.col("status") == "success") & (F.col("ic") > min_ic) & (F.col("rank_ic") > min_rank_ic), F.lit(False))
    out = periods.groupBy(*by).agg(F.count_if(ok).alias("passing"), F.count_if(~ok).alias("failing"))
    return out.withColumn("overall_pass", (F.col("failing") == 0) & (F.col("passing") > 0) if all_must_pass else F.col("passing") >= min_pass)


# Weights and ranges of the quality score's parts, and its divisor.
QUALITY_PARTS = {"rank_ic_test": (1.5, 0.0, 0.05), "rank_icir": (1.0, 0.0, 0.80), "monotonicity": (0.8, 0.0, 1.0), "novelty": (0.6, 0.0, 1.0), "stability": (0.5, 0.0, 1.0), "turnover": (-0.8, 0.30, 1.20), "similarity": (-0.8, 0.0, 1.0), "symbol_length": (-0.5, 20.0, 80.0)}


def quality_score(rows: DataFrame, active: tuple[float, float] = (0.70, 0.02), candidate: tuple[float, float] = (0.45, 0.0)) -> DataFrame:
    """rows with quality_score (0 to 1) and lifecycle; columns rank_ic_test, rank_icir, monotonicity, similarity, stability, turnover, symbol_length, lookahead_risk."""
    known = {n: _or_zero(F.col(n)) for n in QUALITY_PARTS if n not in ("novelty", "symbol_length")} | {"symbol_length": F.coalesce("symbol_length", F.lit(20.0))}
    known["novelty"] = 1 - known["similarity"]
    critical = F.coalesce(F.col("lookahead_risk") == "critical", F.lit(False))
    parts = [w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (known[n] - low) / (high - low))) for n, (w, low, high) in QUALITY_PARTS.items()]
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sum(parts[1:], parts[0]) - critical.cast("double")) / 3.6))

    def reaches(limits: tuple[float, float]) -> Column:
        return (F.col("quality_score") >= limits[0]) & (known["rank_ic_test"] > limits[1])

    return rows.withColumn("quality_score", score).withColumn("lifecycle", F.when(critical, "quarantine").when(reaches(active), "active").when(reaches(candidate), "candidate").otherwise("rejected"))


def failure_attribution(rows: DataFrame) -> DataFrame:
    """rows with decision, primary_reason and secondary_reasons; columns rank_ic_test, turnover, lookahead_risk, reasons (array)."""
    def given(reason: str) -> Column:
        return F.coalesce(F.array_contains("reasons", reason), F.lit(False))

    primary = F.when(F.col("lookahead_risk") == "critical", "lookahead_risk").when(F.col("rank_ic_test") <= 0, "weak_oos_ic")
    for reason in ("too_many_nan", "constant_signal", "high_similarity"):
        primary = primary.when(given(reason), reason)
    out = rows.withColumn("primary_reason", primary.otherwise("weak_ic"))
    high = F.array_compact(F.array(F.when(F.col("turnover") > 0.8, F.lit("high_turnover"))))
    others = F.array_distinct(F.concat(high, F.filter(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: r != F.col("primary_reason"))))
    return out.withColumns({"decision": F.when(F.col("primary_reason") == "lookahead_risk", "quarantine").otherwise("rejected"), "secondary_reasons": F.array_join(others, ",")})


# The code of each failure reason, and the group and severity of each code ('unknown' and 'low' without one).
REASON_CODES = {
    "lookahead_risk": "LOOKAHEAD_DETECTED",
    "too_many_nan": "TOO_MANY_NAN",
    "constant_signal": "CONSTANT_SIGNAL",
    "high_similarity": "HIGH_SIMILARITY",
    "high_turnover": "HIGH_TURNOVER",
    "weak_oos_ic": "WEAK_OOS_IC",
    "weak_ic": "WEAK_OOS_IC",
}
CODE_GROUPS = {
    "LOOKAHEAD_DETECTED": "data_leakage",
    "ANTI_PATTERN_DETECTED": "data_leakage",
    "LOW_COVERAGE": "data_quality",
    "TOO_MANY_NAN": "data_quality",
    "CONSTANT_SIGNAL": "signal_shape",
    "EXTREME_VALUE_SIGNAL": "signal_shape",
    "HIGH_SIMILARITY": "redundancy",
    "HIGH_TURNOVER": "tradability",
    "WEAK_OOS_IC": "predictive_power",
    "POOR_MONOTONICITY": "predictive_power",
}
HIGH_SEVERITY = ["LOOKAHEAD_DETECTED", "ANTI_PATTERN_DETECTED"]
MEDIUM_SEVERITY = ["LOW_COVERAGE", "TOO_MANY_NAN", "CONSTANT_SIGNAL", "EXTREME_VALUE_SIGNAL", "HIGH_SIMILARITY"]
# What to do next about a primary reason ('change_window' without one), and in which words.
NEXT_ACTIONS = {"lookahead_risk": "discard", "high_similarity": "discard", "weak_oos_ic": "discard", "constant_signal": "simplify", "too_complex": "simplify"}
INSTRUCTIONS = {
    "lookahead_risk": "Remove all forward-looking operators and rebuild from lagged daily fields only.",
    "weak_oos_ic": "Change horizon or factor family; do not optimize only in-sample IC.",
    "high_similarity": "Switch to an orthogonal factor family or add a genuinely different normalizer.",
    "high_turnover": "Smooth the signal or lengthen the horizon before retrying.",
    "constant_signal": "Use a continuous cross-sectional transformation with enough unique values.",
}
OTHER_INSTRUCTION = "Revise the signal based on the primary failure reason."


def _looked_up(key: Column, names: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key), F.lit(otherwise))


def failure_codes(rows: DataFrame) -> DataFrame:
    """failure_attribution's columns with reason_codes, reason_code, reason_group, reason_severity, action_type and instruction.

    reason_codes lists, joined by commas and in a set order, what lookahead_risk,
    failure_type, reasons, turnover (above 0.8), rank_ic_test (at most 0) and
    group_monotonicity_score (below 0.35) say; columns that are absent or null say
    nothing.  The first is reason_code; without any it is the primary reason's.
    """
    absent = {"failure_type": "string", "group_monotonicity_score": "double"}
    out = failure_attribution(rows.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in rows.columns}))

    def named(*reasons: str) -> Column:
        return F.coalesce(F.arrays_overlap("reasons", F.array(*map(F.lit, reasons))), F.lit(False))

    said = {
        "LOOKAHEAD_DETECTED": (F.col("lookahead_risk") == "critical") | named("lookahead_risk"),
        "ANTI_PATTERN_DETECTED": (F.col("failure_type") == "expression_anti_pattern") | named("expression_anti_pattern"),
        "LOW_COVERAGE": named("low_coverage", "low_cross_section_coverage", "low_active_days"),
        "TOO_MANY_NAN": named("too_many_nan"),
        "CONSTANT_SIGNAL": named("constant_signal"),
        "EXTREME_VALUE_SIGNAL": named("extreme_values"),
        "HIGH_SIMILARITY": named("high_similarity"),
        "HIGH_TURNOVER": F.col("turnover") > 0.8,
        "WEAK_OOS_IC": F.col("rank_ic_test") <= 0,
        "POOR_MONOTONICITY": F.col("group_monotonicity_score") < 0.35,
    }
    codes = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in said.items())))
    out = out.withColumn("_codes", F.when(F.size(codes) > 0, codes).otherwise(F.array(_looked_up(F.col("primary_reason"), REASON_CODES, "UNKNOWN"))))
    code = F.col("_codes")[0]
    severity = F.when(code.isin(HIGH_SEVERITY), "high").when(code.isin(MEDIUM_SEVERITY), "medium").otherwise("low")
    out = out.withColumns({"reason_codes": F.array_join("_codes", ","), "reason_code": code, "reason_group": _looked_up(code, CODE_GROUPS, "unknown"), "reason_severity": severity})
    return out.withColumns({"action_type": _looked_up(F.col("primary_reason"), NEXT_ACTIONS, "change_window"), "instruction": _looked_up(F.col("primary_reason"), INSTRUCTIONS, OTHER_INSTRUCTION)}).drop("_codes", *(c for c in absent if c not in rows.columns))


def repaired(before: DataFrame, after: DataFrame) -> DataFrame:
    """factor, failure_resolved, quality_improved, repair_success of two attempts (factor, primary_reason, quality_score, lifecycle)."""
    a, b = (f.select("factor", *(F.col(c).alias(f"{p}_{c}") for c in ("primary_reason", "quality_score", "lifecycle"))) for f, p in ((before, "a"), (after, "b")))
    both = a.join(b, "factor")
    resolved = F.coalesce((F.col("a_primary_reason") != "") & ~F.col("a_primary_reason").eqNullSafe(F.col("b_primary_reason")), F.lit(False))
    better = F.coalesce(F.col("b_quality_score") > F.col("a_quality_score"), F.lit(False))
    lifted = F.coalesce(F.col("b_lifecycle").isin("active", "candidate"), F.lit(False))
    return both.select("factor", resolved.alias("failure_resolved"), better.alias("quality_improved"), (resolved & (better | lifted)).alias("repair_success"))


def family_inventory(pool: DataFrame, statuses: Sequence[str], hits: Sequence[str] = ("active", "candidate")) -> DataFrame:
    """family, n, a count for each status, hit_rate: the share of `hits`."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return pool.groupBy("family").agg(F.count("*").alias("n"), *counts, F.avg(F.coalesce(F.col("status").isin(list(hits)), F.lit(False)).cast("double")).alias("hit_rate"))


def behaviour_similarity(correlations: DataFrame) -> DataFrame:
    """factor, its most similar pool factor, and the median and 90 % point of their daily absolute correlations; ties by name."""
    each = correlations.groupBy("factor", "pool_factor").agg(F.percentile(F.abs("correlation"), F.array(F.lit(0.5), F.lit(0.9))).alias("_q"))  # over dates
    order = Window.partitionBy("factor").orderBy(F.desc(F.col("_q")[0]), "pool_factor")
    best = each.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select("factor", "pool_factor", F.col("_q")[0].alias("similarity_median"), F.col("_q")[1].alias("similarity_p90"))


def without_duplicates(candidates: DataFrame, pool: DataFrame, limit: float = 0.99) -> DataFrame:
    """Rows of the candidates whose mean absolute daily correlation with every pool factor is below the limit."""
    means = pool_correlations(candidates, pool, by="value").groupBy("factor", "pool_factor").agg(F.avg(F.abs("correlation")).alias("c"))
    return candidates.join(means.where(F.col("c") >= limit).select("factor").distinct(), "factor", "left_anti")


def pruned(wide: DataFrame, factors: Sequence[str], limit: float = 0.70) -> list[str]:
    """Factors left after dropping, from left to right, each whose correlation with one kept before is above the limit.

    All pairs come from one aggregate; what reaches the driver is their number.
    """
    pairs = [(i, j) for i in range(len(factors)) for j in range(i)]
    cells = [safe_corr(f"`{factors[j]}`", f"`{factors[i]}`").alias(f"r{i}_{j}") for i, j in pairs]
    row = wide.agg(*cells).first() if cells else {}
    kept: list[int] = []
    for i in range(len(factors)):
        if all((row[f"r{i}_{j}"] or 0.0) <= limit for j in kept):
            kept.append(i)
    return [factors[i] for i in kept]


def validated(long: DataFrame, most_nan: float = 0.6, least_valid: float = 0.4, least_distinct: int = 2) -> DataFrame:
    """factor, nan_ratio, valid_ratio, n_unique, valid."""
    v = finite("value")
    out = long.groupBy("factor").agg(F.avg(v.isNull().cast("double")).alias("nan_ratio"), F.avg(v.isNotNull().cast("double")).alias("valid_ratio"), F.count_distinct(v).alias("n_unique"))
    return out.withColumn("valid", (F.col("nan_ratio") <= most_nan) & (F.col("valid_ratio") >= least_valid) & (F.col("n_unique") >= least_distinct))


def implementation_report(made: DataFrame, truth: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row comparing two implementations of a factor, rows (datetime, instrument, value).

    infinite values, row ratio, Jaccard of keys, equal null counts, share of
    equal values, and mean daily coefficients of one against the other.
    """
    a = made.select("datetime", "instrument", F.col("value").alias("_a"), F.lit(1).alias("_in_a"))
    b = truth.select("datetime", "instrument", F.col("value").alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, ["datetime", "instrument"], "full_outer")
    shared = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    close = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.col("_a").isNull() & F.col("_b").isNull()).otherwise(F.abs(F.col("_a") - F.col("_b")) <= tolerance)
    counts = both.agg(
        F.count_if(F.abs("_a") == float("inf")).alias("inf_count"), F.try_divide(F.count("_in_a"), F.count("_in_b")).alias("row_ratio"), F.try_divide(F.count_if(shared), F.count("*")).alias("key_jaccard"),
        (F.count_if(F.col("_in_a").isNotNull() & F.col("_a").isNull()) == F.count_if(F.col("_in_b").isNotNull() & F.col("_b").isNull())).alias("same_nulls"), F.avg(F.when(shared, close.cast("double"))).alias("equal_ratio"),
    )
    ic = daily_ic(both.where(shared), "_a", "_b").agg(F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"))
    return counts.crossJoin(ic)  # a row each


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """category, factor, n_runs, run_success_rate, format_success_rate, avg_corr, max_corr; totals by category have a null factor."""
    return runs.rollup("category", "factor").agg(
        F.count("*").alias("n_runs"), F.avg(F.col("run_ok").cast("double")).alias("run_success_rate"), F.avg(F.col("format_ok").cast("double")).alias("format_success_rate"), F.avg("corr").alias("avg_corr"), F.max("corr").alias("max_corr")
    ).where("category is not null")


def ic_export(daily: DataFrame, optional: Sequence[str] = (), factors: Sequence[str] | None = None, between: tuple[str, str] | None = None) -> DataFrame:
    """The contract's columns (date, factor_id, ic, rank_ic), optional ones null where absent, filtered and sorted."""
    out = daily.select("date", "factor_id", "ic", "rank_ic", *(F.col(c) if c in daily.columns else F.lit(None).cast("double").alias(c) for c in optional))
    if factors is not None:
        out = out.where(F.col("factor_id").isin(list(factors)))
    return (out.where(F.col("date").between(*between)) if between else out).orderBy("date", "factor_id")


def namespaced(metrics: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows (metric, value) with their namespace: that of the first prefix that fits, else other."""
    space = F.coalesce(*(F.when(F.col("metric").startswith(p), F.lit(n)) for p, n in rules.items()), F.lit("other"))
    return metrics.withColumn("namespace", space)


def signal_report(frame: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., mean coefficients and their ratios, aligned rows, active days, mean cross-section, and the share of rows with both values."""
    from .signal import ic_summary

    out = ic_summary(daily_ic(frame, score, label, (*by, "datetime")), by)
    both = F.avg((F.col(score).isNotNull() & F.col(label).isNotNull()).cast("double")).alias("valid_ratio")
    whole = frame.groupBy(*by).agg(both)
    return out.join(whole, list(by)) if by else out.crossJoin(whole)  # a row each


def distinct_metrics(report: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, n: how many different values each metric takes over the factors of a report."""
    return report.unpivot([], list(metrics), "metric", "_v").groupBy("metric").agg(F.count_distinct("_v").alias("n"))


def tradability(frame: DataFrame, score: str, label: str, cost: float = 0.001, groups: int = 5) -> DataFrame:
    """One row: turnover of the top group, spread of the extreme groups, monotonicity, and return and ratio after cost.

    Groups are by rank of the score within a date, ties by instrument; a date
    needs as many rows as groups for means, two for spreads.  Monotonicity: the
    share of neighbouring groups whose mean rises.  What depends on order in
    time works on a row a date.
    """
    rows = frame.where(finite(score).isNotNull() & finite(label).isNotNull()).select("datetime", "instrument", F.col(score).alias("_s"), F.col(label).alias("_l"))
    w = Window.partitionBy("datetime")
    ranked = rows.withColumns({"_n": F.count("*").over(w), "_up": F.row_number().over(w.orderBy("_s", "instrument")) - 1, "_down": F.row_number().over(w.orderBy(F.desc("_s"), "instrument"))})
    of = F.least(F.lit(groups), F.col("_n"))
    ranked = ranked.withColumns({"_g": F.least(of - 1, F.floor(F.col("_up") * of / F.col("_n"))), "_top": (F.col("_n") >= 2) & (F.col("_down") <= F.greatest(F.lit(1), F.ceil(F.col("_n") / groups)))})
    means = ranked.groupBy("datetime", "_n", "_g").agg(F.avg("_l").alias("_m"))
    spreads = means.where("_n >= 2").groupBy("datetime").agg((F.max_by("_m", "_g") - F.min_by("_m", "_g")).alias("_d"), F.max("_n").alias("_n"))
    profile = means.where(F.col("_n") >= groups).groupBy("_g").agg(F.avg("_m").alias("_m"))
    rises = profile.withColumn("_r", F.col("_m") - F.lag("_m").over(Window.orderBy("_g"))).agg(_or_zero(F.avg((F.col("_r") > 0).cast("double"))).alias("group_monotonicity_score"))  # a row a group
    sets = ranked.groupBy("datetime").agg(F.collect_set(F.when(F.col("_top"), F.col("instrument"))).alias("_set"))
    before = sets.withColumn("_b", F.lag("_set").over(Window.orderBy("datetime"))).where("_b is not null")  # a row a date
    change = 1 - _or_zero(F.try_divide(F.size(F.array_intersect("_set", "_b")).cast("double"), F.size(F.array_union("_set", "_b"))))
    turned = before.agg(_or_zero(F.avg(F.when(F.size(F.array_union("_set", "_b")) == 0, 0.0).otherwise(change))).alias("turnover"))
    sums = spreads.agg(_or_zero(F.avg("_d")).alias("_gross"), F.stddev_samp("_d").alias("_sd"), _or_zero(F.avg(F.when(F.col("_n") >= groups, F.col("_d")))).alias("long_short_spread"))
    out = turned.crossJoin(sums).crossJoin(rises)  # a row each
    net = F.col("_gross") - cost * F.col("turnover")
    return out.select("turnover", net.alias("cost_adjusted_return"), F.when(F.col("_sd") > 1e-12, net / F.col("_sd")).otherwise(0.0).alias("cost_adjusted_ir"), "group_monotonicity_score", "long_short_spread")


def status_report(pool: DataFrame, gates: DataFrame) -> DataFrame:
    """section, name, n, value of a pool (status, tier, health_score) and its gate log (gate_result, reason): counts by status and tier, failures by reason, mean health."""
    none = F.lit(None).cast("double")
    parts = [pool.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(c).alias("section"), F.col(c).alias("name"), "n", none.alias("value")) for c in ("status", "tier")]
    parts.append(gates.where("gate_result <> 'pass'").groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("gate_failure").alias("section"), F.col("reason").alias("name"), "n", none.alias("value")))
    parts.append(pool.agg(F.count("health_score").alias("n"), F.avg("health_score").alias("value")).select(F.lit("health").alias("section"), F.lit("mean").alias("name"), "n", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-6, atol: float = 1e-8) -> DataFrame:
    """column, only_left, only_right, rows, max_abs_diff, mean_abs_diff, passed: two frames by their keys, value column by value column.

    Equal nulls pass; a key of one side only fails every column.
    """
    a = left.select(*keys, *(F.col(c).cast("double").alias(f"_a_{c}") for c in columns), F.lit(True).alias("_in_a"))
    b = right.select(*keys, *(F.col(c).cast("double").alias(f"_b_{c}") for c in columns), F.lit(True).alias("_in_b"))
    both = a.join(b, list(keys), "full_outer")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_a_{c}").alias("a"), F.col(f"_b_{c}").alias("b")) for c in columns)))
    rows = both.select("_in_a", "_in_b", pairs.alias("_p")).select("_in_a", "_in_b", "_p.*")
    shared = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    gap = F.abs(F.col("a") - F.col("b"))
    close = (F.col("a").isNull() & F.col("b").isNull()) | F.coalesce(gap <= atol + rtol * F.abs("b"), F.lit(False))
    return rows.groupBy("column").agg(
        F.count_if(F.col("_in_b").isNull()).alias("only_left"), F.count_if(F.col("_in_a").isNull()).alias("only_right"), F.count_if(shared).alias("rows"),
        _or_zero(F.max(F.when(shared, gap))).alias("max_abs_diff"), _or_zero(F.avg(F.when(shared, gap))).alias("mean_abs_diff"), F.bool_and(shared & close).alias("passed"),
    )
