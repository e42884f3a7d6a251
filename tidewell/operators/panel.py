"""Panel building: completion, fills, point-in-time joins, event windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["datetime", "instrument"]


def calendar(frame: DataFrame, date: str = "datetime") -> DataFrame:
    return frame.select(F.col(date).alias("datetime")).distinct()


def completed(panel: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Every instrument on every date; cells without an observation are null.

    The full grid is the result itself, a cross join of dates and instruments;
    neither side is broadcast unless Spark finds it small.
    """
    grid = (dates if dates is not None else calendar(panel)).crossJoin(panel.select("instrument").distinct())
    return grid.join(panel, KEYS, "left")


def filled(panel: DataFrame) -> DataFrame:
    """Fills a completed panel: prices from the last close, volume 0, return 0 when suspended; with a marker for each."""
    w = Window.partitionBy("instrument").orderBy("datetime")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    core = ["open", "high", "low", "close", "volume", "vwap"]
    markers = {f"{c}_was_missing": F.col(c).isNull() for c in core}
    suspended = F.col("volume_was_missing") | (F.col("volume") <= 0)
    out = panel.withColumns(markers).withColumn("is_suspended", suspended)
    out = out.withColumn("close", F.last("close", ignorenulls=True).over(past))
    out = out.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low", "vwap")} | {"volume": F.coalesce("volume", F.lit(0.0))})
    before = F.lag("close").over(w)
    return out.withColumn("ret", F.when(F.col("is_suspended"), 0.0).otherwise(F.coalesce(F.try_divide("close", before) - 1, F.lit(0.0))))


def vwap_or_close(amount: Column, volume: Column, close: Column, unit: float = 1.0) -> Column:
    return F.when(volume > 0, F.try_divide(amount * unit, volume)).otherwise(close)


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """left with the values of right's last row at or before it (strictly before, if strict); null without one.

    Both sides are stacked, sorted once by key and time, and the last right row
    is carried on: one shuffle, no growth in rows.  Of right rows with one key
    and time, the one with the largest values counts.
    """
    row = F.struct(*(F.col(f"`{v}`") for v in values))
    kept = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    last = right.where(F.col(right_at).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(right_at).alias("_t")).agg(F.max(row).alias("_v"))
    mine, theirs = (0, 1) if strict else (1, 0)  # which of two rows of one time comes first
    stacked = left.select(F.col(by).alias("_k"), F.col(left_at).alias("_t"), F.lit(mine).alias("_o"), kept.alias("_l")).unionByName(last.withColumn("_o", F.lit(theirs)), allowMissingColumns=True)
    past = Window.partitionBy("_k").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn("_v", F.last("_v", ignorenulls=True).over(past)).where("_l is not null")
    return found.select("_l.*", *(F.col(f"_v.`{v}`").alias(v) for v in values))


def event_window(panel: DataFrame, events: DataFrame, days: int, happened: str, visible: str, amount: str) -> DataFrame:
    """panel with count, amount and recency (days) of events in the last `days` days that were visible by then.

    A sweep over each instrument's time: an event adds to running sums on the
    day from which it counts and is taken off on the day after it last counts,
    so that two rows an event meet the panel however many days it counts for.
    Sums are decimals of 12 places: what is taken off leaves nothing behind.  The
    latest event that has begun gives the recency, as those before it end
    sooner.  Events without both dates do not count; a null amount counts as 0.
    """
    begun = events.where(F.col(visible) <= F.date_add(F.col(happened), days - 1)).select("instrument", F.col(happened).alias("_h"), F.greatest(happened, visible).alias("_t"), F.col(amount).cast("double").try_cast("decimal(38,12)").alias("_a"))
    starts = begun.select("instrument", "_t", F.lit(1).alias("_n"), "_a", "_h")
    ends = begun.select("instrument", F.date_add("_h", days).alias("_t"), F.lit(-1).alias("_n"), (-F.col("_a")).alias("_a"), F.lit(None).cast("date").alias("_h"))
    steps = starts.unionByName(ends).groupBy("instrument", "_t").agg(F.sum("_n").alias("_n"), F.sum("_a").cast("decimal(38,12)").alias("_a"), F.max("_h").alias("_h"))
    rows = panel.select("instrument", F.col("datetime").alias("_t"), F.struct(*(F.col(f"`{c}`") for c in panel.columns)).alias("_row"))
    stacked = steps.unionByName(rows, allowMissingColumns=True)
    past = Window.partitionBy("instrument").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a day's steps count on that day
    swept = stacked.withColumns({"_n": F.sum("_n").over(past), "_a": F.sum("_a").over(past), "_h": F.max("_h").over(past)}).where("_row is not null")
    age = F.datediff("_t", "_h")
    return swept.select(
        "_row.*",
        F.coalesce("_n", F.lit(0)).alias(f"count_{days}d"),
        F.coalesce(F.col("_a").cast("double"), F.lit(0.0)).alias(f"amount_{days}d"),
        F.when(age < days, age).alias("recency"),
    )


def context_by_date(panel: DataFrame, source: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
    """panel with one value of each aggregate for its date; Spark broadcasts the aggregate when its size allows."""
    return panel.join(source.groupBy("datetime").agg(*aggregates), "datetime", "left")


def present_in(panel: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """1.0 where the source has the key, else 0.0."""
    marks = source.select(*KEYS).distinct().withColumn(name, F.lit(1.0))
    return panel.join(marks, KEYS, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def missing_dates(panel: DataFrame, dates: DataFrame) -> DataFrame:
    return dates.join(panel.select("datetime").distinct(), "datetime", "left_anti")


def untradable_prices(panel: DataFrame, prices: Sequence[str] = ("open", "high", "low", "close", "vwap")) -> DataFrame:
    """Rows with volume but without some usable price."""
    bad = F.lit(False)
    for p in prices:
        bad = bad | F.col(p).isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return panel.where((F.col("volume") > 0) & bad)


def last_days(panel: DataFrame, days: int) -> DataFrame:
    """Rows of the last `days` calendar days; the bound is one aggregate, read at planning time."""
    last = panel.agg(F.max("datetime").alias("d")).first().d
    return panel.where(F.col("datetime") > F.date_sub(F.lit(last), days)) if last else panel


def recent_dates(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the n most recent dates."""
    dates = panel.select("datetime").distinct().orderBy(F.desc("datetime")).limit(n)
    return panel.join(dates, "datetime", "left_semi")


def point_in_time(rows: DataFrame, as_of_date: str, keys: Sequence[str], disclosed: str, revision: str) -> DataFrame:
    """The latest revision of each key that was disclosed by the date."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(disclosed), F.desc(revision)))
    return rows.where(F.col(disclosed) <= F.lit(as_of_date).cast("timestamp")).withColumn("_r", rank).where("_r = 1").drop("_r")


def wide(rows: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    return rows.groupBy(key).pivot(name, list(names)).agg(F.first(value))


def trading_calendar(source: DataFrame, date: str, is_open: str | None = None) -> DataFrame:
    """datetime: the open days of a calendar source, or without a flag the distinct days of any source."""
    days = source.where(F.col(is_open).cast("int") == 1) if is_open else source
    return days.where(F.col(date).isNotNull()).select(F.to_date(date).alias("datetime")).distinct()


def require_coverage(panel: DataFrame, dates: DataFrame) -> None:
    """Refuses a panel that lacks open days; names up to ten of them."""
    if gone := missing_dates(panel, dates).orderBy("datetime").limit(10).collect():
        raise ValueError(f"no rows on open days {[str(r.datetime) for r in gone]}")


def daily_batch(panel: DataFrame, source: DataFrame, columns: Sequence[str], policy: str = "null") -> DataFrame:
    """panel with columns of a source's row of its key; a source repeats no key.

    Where there is none: policy null leaves nulls, zero puts 0, required refuses.
    """
    out = panel.join(source.select(*KEYS, *columns, F.lit(True).alias("_here")), KEYS, "left")
    if policy == "required" and (gone := out.where("_here is null").select(*KEYS).limit(3).collect()):
        raise ValueError(f"a required source lacks {[tuple(r) for r in gone]}")
    if policy == "zero":
        out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    return out.drop("_here")


def as_of_aggregate(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, aggregates: dict[str, Column], strict: bool = False) -> DataFrame:
    """left with aggregates of right's rows of the last time at or before it."""
    sums = right.groupBy(by, right_at).agg(*(a.alias(n) for n, a in aggregates.items()))
    return as_of(left, sums, by, left_at, right_at, list(aggregates), strict)


def weighted_context(panel: DataFrame, source: DataFrame, weights: DataFrame, values: Sequence[str]) -> DataFrame:
    """panel with the index-weighted mean of source values by date; weights (datetime, instrument, weight), nulls left out of both sums."""
    both = source.join(weights, KEYS)

    def mean(v: str) -> Column:
        used = F.when(F.col(v).isNotNull(), F.col("weight"))
        return F.try_divide(F.sum(F.col(v) * used), F.sum(used)).alias(f"weighted_{v}")

    return panel.join(both.groupBy("datetime").agg(*(mean(v) for v in values)), "datetime", "left")


def tradable(universe: DataFrame, calendar_: DataFrame, suspended: DataFrame | None = None, st: DataFrame | None = None) -> DataFrame:
    """universe with is_tradable: an open day (cal_date, is_open), not suspended (trade_date, ts_code), not marked is_st."""
    open_ = calendar_.groupBy(F.to_date("cal_date").alias("datetime")).agg(F.max(F.col("is_open").cast("int") == 1).alias("_open"))
    out = universe.join(open_, "datetime", "left")
    no = F.lit(False)
    for frame, name, flag in ((suspended, "_suspended", F.lit(True)), (st, "_st", F.col("is_st").cast("int") == 1 if st is not None else no)):
        if frame is None:
            out = out.withColumn(name, no)
        else:
            marks = frame.groupBy(F.to_date("trade_date").alias("datetime"), F.col("ts_code").cast("string").alias("instrument")).agg(F.max(flag).alias(name))
            out = out.join(marks, KEYS, "left")
    ok = F.coalesce("_open", no) & ~F.coalesce("_suspended", no) & ~F.coalesce("_st", no)
    return out.withColumn("is_tradable", ok).drop("_open", "_suspended", "_st")


def index_members(weights: DataFrame, as_of_date: str, indices: Sequence[str]) -> DataFrame:
    """index_code, con_code, trade_date: of each index, the members on its last weight date not after the date."""
    past = weights.where(F.col("index_code").isin(list(indices)) & (F.to_date("trade_date") <= F.lit(as_of_date).cast("date")))
    last = past.groupBy("index_code").agg(F.max("trade_date").alias("trade_date"))
    return past.join(last, ["index_code", "trade_date"]).select("index_code", "con_code", "trade_date").distinct()


def index_universe(weights: DataFrame, as_of_date: str, indices: Sequence[str], exclude_markets: Sequence[str] = ()) -> DataFrame:
    """instrument: members of any of the indices as of the date, without those of the excluded markets."""
    from ..sources.market import in_markets

    names = index_members(weights, as_of_date, indices).select(F.col("con_code").alias("instrument")).distinct()
    return in_markets(names, exclude=exclude_markets)
