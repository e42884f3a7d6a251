"""Exact quantiles of groups of any size, by passes of histograms over the ordered bits of the values.

A double's bits, turned so that they sort as the value does, are read sixteen
at a time from the front.  Each pass counts rows by the next sixteen bits,
below the leading bits that the wanted ranks are known to have, so a task holds
at most 65,536 counts for a group and a leading pattern, and no list of values
is ever formed.  Four passes over (group, bits) give the values themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType
from pyspark.sql.window import Window

from ..storage import stored

DIGIT = 16  # bits counted in a pass


@F.pandas_udf(LongType())
def _ordered(x: pd.Series) -> pd.Series:
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)  # adding 0 makes one zero of both
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(DoubleType())
def _value(ordered: pd.Series) -> pd.Series:
    bits = ordered.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """by, n, q: the number of values of each group and its exact quantiles at the given shares, interpolated between neighbours.

    Null and NaN values take no part, infinite ones do; a group without values
    has no row; a null key is a group of its own; ties and repeated rows each
    count.  Other columns, whatever their names, are not read.
    """
    x = F.col(value).cast("double")
    bits = stored(rows.where(x.isNotNull() & ~F.isnan(x)).select(F.struct(*by).alias("_g"), _ordered(x).alias("_b")), "bits")
    first = stored(bits.groupBy("_g", F.shiftright("_b", 64 - DIGIT).alias("_d")).agg(F.count("*").alias("_n")), "counts").withColumn("_p", F.lit(0).cast("long"))
    sizes = first.groupBy("_g").agg(F.sum("_n").alias("n"))
    places = [F.lit(float(s)) * (F.col("n") - 1) for s in at]
    ranks = F.array_distinct(F.array(*(r(p).cast("long") for p in places for r in (F.floor, F.ceil))))
    wanted = sizes.select("_g", F.explode(ranks).alias("_goal")).select("_g", "_goal", F.col("_goal").alias("_rank"), F.lit(0).cast("long").alias("_p"))
    for left in range(64 - DIGIT, -1, -DIGIT):
        counts = first
        if left < 64 - DIGIT:
            heads = wanted.select("_g", "_p").distinct()  # a few for each group; Spark broadcasts them while they are small
            under = bits.withColumn("_p", F.shiftright("_b", left + DIGIT)).join(heads, ["_g", "_p"], "left_semi")
            digit = F.shiftright("_b", left).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
            counts = under.groupBy("_g", "_p", digit.alias("_d")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_g", "_p").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_to", upto)
        found = wanted.join(counts, ["_g", "_p"]).where("_rank < _to and _rank >= _to - _n")
        head = F.col("_d") if left == 64 - DIGIT else F.shiftleft("_p", DIGIT).bitwiseOR(F.col("_d"))
        wanted = stored(found.select("_g", "_goal", (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"), head.alias("_p")), "ranks")
    values = wanted.withColumn("_v", _value("_p")).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_goal", "_v"))).alias("_m"))  # two entries a share
    low = [F.element_at("_m", F.floor(p).cast("long")) for p in places]
    high = [F.element_at("_m", F.ceil(p).cast("long")) for p in places]
    part = [p - F.floor(p) for p in places]
    q = F.array(*(F.when((a == b) | (w == 0), a).otherwise(a * (1 - w) + b * w) for a, b, w in zip(low, high, part)))
    return values.join(sizes, "_g").select("_g.*", "n", q.alias("q"))


def medians_and_spreads(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, _med, _mad: exact median of each group and of the absolute distances from it."""
    middle = stored(quantiles(rows, by, value, [0.5]).select(*by, F.col("q")[0].alias("_med")), "medians")
    away = _with(rows.select(*by, F.col(value).alias("_v")), middle, by).withColumn("_away", F.abs(F.col("_v") - F.col("_med")))
    spread = quantiles(away, by, "_away", [0.5]).select(*by, F.col("q")[0].alias("_mad"))
    return _with(middle, spread, by)


def _with(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of their group, null where there is none; null keys meet."""
    named = groups.withColumnsRenamed({c: f"_g_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    return rows.join(named, on, "left").drop(*(f"_g_{c}" for c in by))


def winsorized(frame: DataFrame, value: str, k: float, by: Sequence[str]) -> DataFrame:
    """frame with the value held within k median distances of its group's median, for groups of any size; null stays null."""
    out = _with(frame, stored(medians_and_spreads(frame, by, value), "spreads"), by)
    reach = k * F.col("_mad")
    held = F.greatest(F.least(F.col(value), F.col("_med") + reach), F.col("_med") - reach)
    return out.withColumn(value, F.when(F.col(value).isNotNull(), held)).drop("_med", "_mad")


def clipped(frame: DataFrame, value: str, low: float, high: float, by: Sequence[str]) -> DataFrame:
    """frame with the value held within two quantiles of its group, for groups of any size; null stays null."""
    cut = stored(quantiles(frame, by, value, [low, high]).select(*by, F.col("q").alias("_q")), "cuts")
    out = _with(frame, cut, by)
    held = F.greatest(F.least(F.col(value), F.col("_q")[1]), F.col("_q")[0])
    return out.withColumn(value, F.when(F.col(value).isNotNull(), held)).drop("_q")
