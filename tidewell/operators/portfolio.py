"""Portfolios: holdings from ranks of scores, weights from factor health, diagnostics.

Holdings follow from windows over each instrument's rows, with no loop over
days: an instrument is wanted from the day on which it ranks among the best, and
no longer from the day on which it falls out of a wider band; trades happen on
the first later row with a usable open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite
from .signal import risk


def _usable(price: str) -> Column:
    return F.coalesce(finite(price) > 0, F.lit(False))


def holdings(frame: DataFrame, topk: int = 50, n_drop: int = 5, risk_degree: float = 0.95) -> DataFrame:
    """The rows (portfolio, datetime, instrument, score, open, close) with wanted, held, weight, weight_before and day_return.

    Scores rank within a portfolio's date, ties by instrument; a score that is
    null or not finite, or a row whose boolean column `allowed`, if there is one,
    is not true, has no rank.  The best `topk` are wanted from the next row on,
    those beyond topk + n_drop or without a rank no longer; between them, what
    was before goes on.  A row without a usable open changes nothing.  Those held
    share risk_degree of the day's capital equally.  day_return compares closes,
    the last usable one carried on, and is 0 without two of them.
    """
    of_day, of_one = Window.partitionBy("portfolio", "datetime"), Window.partitionBy("portfolio", "instrument").orderBy("datetime")
    so_far, before = of_one.rowsBetween(Window.unboundedPreceding, 0), of_one.rowsBetween(Window.unboundedPreceding, -1)
    able = finite("score").isNotNull()
    if "allowed" in frame.columns:
        able &= F.coalesce("allowed", F.lit(False))
    ranked = frame.withColumn("_able", able)
    ranked = ranked.withColumn("_rank", F.when(F.col("_able"), F.row_number().over(of_day.orderBy(F.desc("_able"), F.desc("score"), "instrument"))))
    inside, outside = F.col("_rank") <= topk, F.col("_rank").isNull() | (F.col("_rank") > topk + n_drop)
    marked = ranked.withColumn("_mark", F.when(inside, True).when(outside, False))
    wanted = marked.withColumn("wanted", F.coalesce(F.last("_mark", ignorenulls=True).over(before), F.lit(False)))
    held = wanted.withColumn("held", F.coalesce(F.last(F.when(_usable("open"), F.col("wanted")), ignorenulls=True).over(so_far), F.lit(False)))
    held = held.withColumn("_close", F.last(F.when(_usable("close"), F.col("close")), ignorenulls=True).over(so_far))
    n = F.sum(F.col("held").cast("int")).over(of_day)
    weighed = held.withColumn("weight", F.when(F.col("held"), risk_degree / n).otherwise(0.0))
    out = weighed.withColumns({"weight_before": F.coalesce(F.lag("weight").over(of_one), F.lit(0.0)), "day_return": F.coalesce(F.try_divide(F.col("_close"), F.lag("_close").over(of_one)) - 1, F.lit(0.0))})
    return out.drop("_able", "_rank", "_mark", "_close")


def positions(held: DataFrame) -> DataFrame:
    return held.where("held").select("portfolio", F.col("datetime").alias("date"), "instrument", "weight")


def reports(held: DataFrame, benchmark: DataFrame | None = None, capital: float = 1e8, open_cost: float = 0.0, close_cost: float = 0.0) -> DataFrame:
    """portfolio, date, return, bench, cost, turnover, equity, excess_return; benchmark has (date, bench), 0 without one.

    Weights of the row before earn the day's return; changes of weights are the
    turnover, and cost their rate by side.
    """
    change = F.col("weight") - F.col("weight_before")
    rates = F.greatest(change, F.lit(0.0)) * open_cost + F.greatest(-change, F.lit(0.0)) * close_cost
    days = held.groupBy("portfolio", F.col("datetime").alias("date")).agg(F.sum(F.col("weight_before") * F.col("day_return")).alias("return"), F.sum(rates).alias("cost"), F.sum(F.abs(change)).alias("turnover"))
    days = days.join(benchmark, "date", "left") if benchmark is not None else days.withColumn("bench", F.lit(0.0))
    grown = F.sum(F.log1p(F.col("return") - F.col("cost"))).over(Window.partitionBy("portfolio").orderBy("date"))  # a row for each date
    days = days.withColumns({"bench": F.coalesce("bench", F.lit(0.0)), "equity": capital * F.exp(grown)})
    return days.withColumn("excess_return", F.col("return") - F.col("bench") - F.col("cost"))


def missing_prices(held: DataFrame, examples: int = 20) -> tuple[DataFrame, DataFrame]:
    """Counts by portfolio and reason, and the first examples of each portfolio: trades without an open, holdings without a close."""
    of_one = Window.partitionBy("portfolio", "instrument").orderBy("datetime")
    held = held.withColumn("_was", F.coalesce(F.lag("held").over(of_one), F.lit(False)))
    wanted, was = F.col("wanted"), F.col("_was")
    reason = F.when(~_usable("open") & wanted & ~was, "skip_buy").when(~_usable("open") & ~wanted & was, "skip_sell_keep_position")
    late = F.when(~_usable("close") & F.col("held"), "carry_forward_last_close")
    rows = held.withColumn("reason", F.explode(F.array_compact(F.array(reason, late)))).select("portfolio", F.col("datetime").alias("date"), "instrument", "reason")
    first = F.row_number().over(Window.partitionBy("portfolio").orderBy("date", "instrument", "reason"))
    return rows.groupBy("portfolio", "reason").agg(F.count("*").alias("n")), rows.withColumn("_r", first).where(F.col("_r") <= examples).drop("_r")


def portfolio_risk(report: DataFrame) -> DataFrame:
    """Risk figures of each portfolio's excess returns."""
    return risk(report.select("portfolio", "date", F.col("excess_return").alias("excess")), ["portfolio"])


def benchmark_returns(market: DataFrame, benchmark: str | None = None) -> DataFrame:
    """date, bench: the day's mean return, or that of a named instrument, which must be there every day."""
    if benchmark is None or benchmark.lower() == "mean":
        return market.groupBy(F.col("datetime").alias("date")).agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("bench"))
    own = market.where(F.col("instrument").isin(benchmark, benchmark.lower())).select(F.col("datetime").alias("date"), F.col("ret").alias("bench"))
    days = market.select(F.col("datetime").alias("date")).distinct()
    if gone := days.join(own, "date", "left_anti").orderBy("date").limit(3).collect():
        raise KeyError(f"benchmark {benchmark} is missing on {[str(r.date) for r in gone]}")
    return own


# --- weights --------------------------------------------------------------------


def regime_scale(high_vol: Column, crisis: Column, least: float = 0.25) -> Column:
    """Exposure left by the larger of two probabilities, `least` at least."""
    return F.greatest(F.lit(least), 1 - F.least(F.lit(1.0), F.greatest(high_vol, crisis, F.lit(0.0))))


def factor_weights(factors: DataFrame, by: Sequence[str] = (), scale: Column | float = 1.0) -> DataFrame:
    """factors with weight: softmax of health_score / 10 times dynamic_weight and the scale, capped by tier_cap (null: 1), made to sum to 1; all 0 if the sum is."""
    w = Window.partitionBy(*by)
    x = F.exp(F.col("health_score") / 10 - F.max(F.col("health_score") / 10).over(w))
    out = factors.withColumn("_p", x).withColumn("_p", F.col("_p") / F.sum("_p").over(w))
    out = out.withColumn("_c", F.least(F.col("_p") * F.coalesce("dynamic_weight", F.lit(0.0)) * scale, F.coalesce("tier_cap", F.lit(1.0))))
    total = F.sum("_c").over(w)
    return out.withColumn("weight", F.when(total == 0, 0.0).otherwise(F.col("_c") / total)).drop("_p", "_c")


def stock_weights(values: DataFrame, weights: DataFrame, most: float = 0.05) -> DataFrame:
    """datetime, instrument, weight: weighted sums of factor values (datetime, instrument, factor, value), centred by date, the largest at `most`, and without drift."""
    scores = values.join(weights.select("factor", "weight"), "factor").groupBy("datetime", "instrument").agg(F.sum(F.coalesce("value", F.lit(0.0)) * F.col("weight")).alias("_s"))
    w = Window.partitionBy("datetime")
    centred = scores.withColumn("_s", F.col("_s") - F.avg("_s").over(w))
    scaled = centred.withColumn("_w", F.coalesce(F.try_divide(F.col("_s") * most, F.max(F.abs("_s")).over(w)), F.lit(0.0)))
    return scaled.select("datetime", "instrument", (F.col("_w") - F.avg("_w").over(w)).alias("weight"))


# The tiers of a model's input.
TIERS = ["A", "B", "C", "D"]


def model_inputs(factors: DataFrame, regimes: DataFrame, quota: int) -> DataFrame:
    """Factors that a model may use, `quota` of each cluster by health, with tiers as columns, health from 0 to 1, and each date's regime columns."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("health_score"), "factor"))
    able = factors.where("model_eligible").withColumn("_r", rank).where(F.col("_r") <= quota)
    shown = able.select("factor", "cluster_id", *((F.col("tier") == t).cast("double").alias(f"tier_{t.lower()}") for t in TIERS), (F.col("health_score") / 100).alias("health"))
    return shown.crossJoin(regimes)  # the table is this product: every factor on every date


def period_runs(periods: Sequence[dict]) -> list[dict]:
    """One run for each (train, valid, test) period; nameless, incomplete or reversed ones are refused."""
    out = []
    for p in periods:
        if not str(p.get("name") or "").strip():
            raise ValueError("a period has no name")
        for part in ("train", "valid", "test"):
            bounds = p.get(part)
            if not isinstance(bounds, (list, tuple)) or len(bounds) != 2 or str(bounds[0]) > str(bounds[1]):
                raise ValueError(f"period {p['name']} has no proper {part}")
        out.append({"name": str(p["name"]).strip(), **{part: tuple(map(str, p[part])) for part in ("train", "valid", "test")}})
    return out
