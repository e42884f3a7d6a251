"""Tables and panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_source(
    frame: DataFrame,
    date: str | None = None,
    between: tuple[str, str] | None = None,
    columns: Sequence[str] | None = None,
    filters: Sequence[tuple[str, str, Any]] = (),
    unique: bool = False,
) -> DataFrame:
    """Projection, date range, predicates and distinct over a source, all of which reach the scan."""
    if date and between:
        frame = frame.where(F.col(date).between(*between))
    for name, op, value in filters:
        frame = frame.where(predicate(name, op, value))
    frame = frame.select(*columns) if columns else frame
    return frame.distinct() if unique else frame


def predicate(name: str, op: str, value: Any) -> Column:
    c = F.col(name)
    known = {"=": c == value, "!=": c != value} if op in ("=", "!=") else {}
    if op == "between":
        return c.between(*value)
    if op == "in":
        return c.isin(list(value))
    return known[op] if known else {"<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}[op](value)


def parse_date(c: Column) -> Column:
    """yyyyMMdd, yyyy-MM-dd or yyyyMM (its first day) as a date; anything else is null."""
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    return F.try_to_date(F.substring(F.when(F.length(digits) == 6, F.concat(digits, F.lit("01"))).otherwise(digits), 1, 8), "yyyyMMdd")


def normalised_market(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames columns; where both the old and the new name are there, the first non-null of them counts."""
    for old, new in names.items():
        if old in frame.columns:
            both = F.coalesce(F.col(f"`{new}`"), F.col(f"`{old}`")) if new in frame.columns else F.col(f"`{old}`")
            frame = frame.withColumn(new, both).drop(old)
    return frame


def first_by(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in a full order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day: open, close, high, low, volume, vwap of event values."""
    e, order = table(spark, sf_dir, "events"), F.struct("ts", "event_id")
    return (
        e.groupBy(F.col("user_id").cast("string").alias("instrument"), F.to_date("ts").alias("datetime"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max_by("value", order).alias("close"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.count("*").cast("double").alias("volume"),
            (F.sum("value") / F.count("*")).alias("vwap"),
        )
    )


def supply_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by ship date: prices per unit, quantity and amount of line items."""
    x = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (
        x.groupBy(F.col("l_suppkey").cast("string").alias("instrument"), F.to_date("l_shipdate").alias("datetime"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max_by("price", order).alias("close"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum("l_quantity").alias("volume"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"),
        )
    )


def instruments_file(spark: SparkSession, path: str) -> DataFrame:
    """First token of each line that is not empty or a comment."""
    line = F.trim("value")
    return spark.read.text(path).where((F.length(line) > 0) & ~line.startswith("#")).select(F.split(line, r"\s+")[0].alias("instrument")).distinct()


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
