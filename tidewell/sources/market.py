"""Market sources and sinks: files, normalised frames, cached frames, binary series, factor values, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType
from pyspark.sql.window import Window

from ..functions.columns import finite
from ..storage import parquet_folders, read_manifest, write_manifest
from . import duplicate_keys, normalised_market, predicate

# Names under which market files hold the frame's columns.
MARKET_NAMES = {"ts_code": "instrument", "trade_date": "datetime", "date": "datetime", "vol": "volume", "$open": "open", "$high": "high", "$low": "low", "$close": "close", "$volume": "volume", "$vwap": "vwap"}
PRICES = ["open", "high", "low", "close"]


def read_file(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A CSV file with a header, read by the given schema, or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV file is read by a schema")
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return spark.read.parquet(path)


def scan(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, filters: Sequence[tuple] = ()) -> DataFrame:
    """Several Parquet files or folders as one frame; columns and filters reach the scan."""
    frame = spark.read.parquet(*paths)
    for name, op, value in filters:
        frame = frame.where(predicate(name, op, value))
    return frame.select(*columns) if columns else frame


def market_frame(raw: DataFrame, amount_unit: float = 1.0, instruments: Sequence[str] | None = None) -> DataFrame:
    """datetime, instrument, open, high, low, close, volume, vwap, ret from a market file's columns.

    vwap: given, else amount * amount_unit / volume where there is volume, else
    close.  ret: of `$return` and pct_chg / 100 the first that is there (both: the
    first non-null), 0 for null; without either, close over the close before
    less 1, 0 for the first.
    """
    frame = normalised_market(raw, {k: v for k, v in MARKET_NAMES.items() if k in raw.columns})
    if missing := [c for c in ("datetime", "instrument", *PRICES) if c not in frame.columns]:
        raise ValueError(f"market data lacks {missing}")
    if instruments is not None:
        frame = frame.where(F.col("instrument").cast("string").isin(list(instruments)))
    here = set(frame.columns)
    volume = F.col("volume").cast("double") if "volume" in here else F.lit(0.0)
    amount = F.col("amount").cast("double") if "amount" in here else F.lit(None).cast("double")
    close = F.col("close").cast("double")
    derived = F.when(volume > 0, F.try_divide(amount * amount_unit, volume)).otherwise(close)
    given = [F.col(c).cast("double") for c in ("`$return`",) if "$return" in here] + [F.col("pct_chg").cast("double") / 100 for _ in (1,) if "pct_chg" in here]
    before = F.lag(close).over(Window.partitionBy("instrument").orderBy("datetime"))
    ret = F.coalesce(*given, F.lit(0.0)) if given else F.coalesce(F.try_divide(close, before) - 1, F.lit(0.0))
    vwap = F.coalesce(F.col("vwap").cast("double"), derived) if "vwap" in here else derived
    return frame.select("datetime", F.col("instrument").cast("string").alias("instrument"), *(F.col(c).cast("double").alias(c) for c in PRICES), volume.alias("volume"), vwap.alias("vwap"), ret.alias("ret"))


def adjusted(frame: DataFrame, mode: str) -> DataFrame:
    """Prices in the wanted adjustment: raw, or the columns that end in _qfq or _hfq in the place of open, high, low and close."""
    if mode == "raw":
        return frame
    if mode not in ("qfq", "hfq"):
        raise ValueError(f"unknown adjustment {mode}")
    if missing := [c for c in PRICES if f"{c}_{mode}" not in frame.columns]:
        raise ValueError(f"no {mode} prices for {missing}")
    return frame.withColumns({c: F.col(f"{c}_{mode}") for c in PRICES})


def in_markets(frame: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = (), code: str = "instrument") -> DataFrame:
    """Rows by the market that the code ends in, after a point; a code without one is in no market."""
    market = F.regexp_extract(F.col(code), r"\.([A-Z]+)$", 1)
    if include is not None:
        frame = frame.where(market.isin(list(include)))
    return frame.where(~market.isin(list(exclude))) if exclude else frame


def stock_filter(instruments: DataFrame, as_of: str | None, exclude_st: bool = False, min_list_days: int = 0, exclude_markets: Sequence[str] = ()) -> DataFrame:
    """Instruments (instrument, is_st or name, list_date) that pass; what is not known excludes nothing."""
    out = in_markets(instruments, exclude=exclude_markets)
    if exclude_st:
        named = F.contains(F.upper("name"), F.lit("ST")) if "name" in out.columns else F.lit(False)
        flag = F.coalesce(F.col("is_st"), named) if "is_st" in out.columns else named
        out = out.where(~F.coalesce(flag, F.lit(False)))
    if min_list_days > 0 and as_of and "list_date" in out.columns:
        out = out.where(F.coalesce(F.datediff(F.lit(as_of).cast("date"), "list_date") >= min_list_days, F.lit(True)))
    return out


def factor_frame(frame: DataFrame, factors: Sequence[str], keys: Sequence[str] = ("datetime", "instrument")) -> DataFrame:
    """keys and factors as doubles, non-finite values null; a frame that repeats a key is refused."""
    if missing := [c for c in (*keys, *factors) if c not in frame.columns]:
        raise ValueError(f"columns {missing} are missing")
    if again := duplicate_keys(frame, list(keys)).limit(3).collect():
        raise ValueError(f"keys are repeated: {[tuple(r)[: len(keys)] for r in again]}")
    return frame.select(*keys, *(finite(F.col(f).cast("double")).alias(f) for f in factors))


def joined_features(frames: Sequence[DataFrame], keys: Sequence[str] = ("datetime", "instrument")) -> DataFrame:
    """Inner join of feature frames on the keys; a value column in two of them is refused."""
    seen: set[str] = set()
    for f in frames:
        own = set(f.columns) - set(keys)
        if seen & own:
            raise ValueError(f"columns {sorted(seen & own)} are in several frames")
        seen |= own
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys))
    return out


def segments(frame: DataFrame, bounds: dict[str, tuple[str, str]], date: str = "datetime") -> DataFrame:
    """Rows of the segments, with the segment's name; ends included.

    Segments that overlap, run backwards or hold no date of the frame are refused.
    """
    ordered = sorted(bounds.items(), key=lambda s: s[1])
    for name, (a, b) in ordered:
        if a > b:
            raise ValueError(f"segment {name} runs backwards")
    for (one, (_, b)), (two, (a, _)) in zip(ordered, ordered[1:]):
        if a <= b:
            raise ValueError(f"segments {one} and {two} overlap")
    day = F.col(date).cast("date")
    inside = {n: day.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for n, (a, b) in bounds.items()}
    have = frame.agg(*(F.max(c).alias(n) for n, c in inside.items())).first()
    if empty := [n for n in bounds if not have[n]]:
        raise ValueError(f"no dates in segments {empty}")
    name = F.coalesce(*(F.when(c, F.lit(n)) for n, c in inside.items()))
    return frame.withColumn("segment", name).where("segment is not null")


def centred_rank(value: Column, by: Sequence[str] = ("datetime",)) -> Column:
    """Percentage rank less a half over the non-null values of a date; 0 where it is the only one."""
    from ..functions.columns import average_rank

    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(value.isNotNull(), F.when(n == 1, 0.0).otherwise(average_rank(value, tuple(by)) / n - 0.5))


# --- written frames -----------------------------------------------------------


def identity(spec: dict) -> str:
    """Name of a frame's specification: the first 16 hex digits of its SHA-256."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_frame(frame: DataFrame, root: str, spec: dict) -> str:
    """Writes a frame and, when it is there whole, its manifest; returns its folder."""
    path = f"{root}/{identity(spec)}"
    frame.write.mode("overwrite").parquet(f"{path}/standard_frame.parquet")
    write_manifest(frame.sparkSession, f"{path}/manifest", {"version": 1, "spec": spec, "columns": frame.columns})
    return path


def load_frame(spark: SparkSession, path: str) -> DataFrame:
    if read_manifest(spark, f"{path}/manifest") is None:
        raise FileNotFoundError(f"{path} holds no whole frame")
    return spark.read.parquet(f"{path}/standard_frame.parquet")


def frame_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of a written frame's columns, from its footer."""
    return spark.read.parquet(f"{path}/standard_frame.parquet").columns


def cached_frame(spark: SparkSession, root: str, spec: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame of a specification, built and written if it is not there yet."""
    path = f"{root}/{identity(spec)}"
    if read_manifest(spark, f"{path}/manifest") is None:
        write_frame(build(), root, spec)
    return load_frame(spark, path)


# The roles of fields, by the first rule that fits.
ROLE_RULES = [("key", r"(^|_)(key|id)$|key$"), ("date", r"(^|_)(date|ts|time)|date$"), ("price", r"price|acctbal|amount"), ("flag", r"flag|status|is_")]


def field_role(name: Column, kind: Column) -> Column:
    """Role of a field from its name, else measure for numbers and label for others."""
    role = F.coalesce(*(F.when(name.rlike(p), F.lit(r)) for r, p in ROLE_RULES))
    return F.coalesce(role, F.when(kind.isin("tinyint", "smallint", "int", "bigint", "float", "double"), "measure").otherwise("label"))


def field_inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """source, field, kind, role of every column, from the schemas alone."""

    def kind(t: DataType) -> str:
        return t.simpleString()

    rows = [(n, f.name, kind(f.dataType)) for n, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "source string, field string, kind string").withColumn("role", field_role(F.col("field"), F.col("kind")))


def available_from(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """source, available_from: the first date of each (frame, date column)."""
    out = None
    for name, (frame, date) in sources.items():
        one = frame.agg(F.to_date(F.min(date)).alias("available_from")).select(F.lit(name).alias("source"), "available_from")
        out = one if out is None else out.unionByName(one)
    return out


def capabilities(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """name, path, status: Parquet files below a folder, merged into those known (name, path); status is known, new or gone."""
    found = spark.createDataFrame([(n.removesuffix(".parquet"), f"{folder}/{n}") for n in parquet_folders(spark, folder)], "name string, path string")
    if known is None:
        return found.withColumn("status", F.lit("new"))
    both = found.join(known.select("name", F.col("path").alias("_old")), "name", "full_outer")
    status = F.when(F.col("path").isNull(), "gone").when(F.col("_old").isNull(), "new").otherwise("known")
    return both.select("name", F.coalesce("path", "_old").alias("path"), status.alias("status"))


def universe(resolved: DataFrame) -> DataFrame:
    """datetime, instrument of the rows that a resolved universe marks as eligible or selected."""
    mark = F.coalesce(*(F.col(c).cast("boolean") for c in ("eligible", "selected") if c in resolved.columns), F.lit(False))
    return resolved.where(mark).select(F.col("trade_date").alias("datetime"), "instrument").distinct()


def library_rows(documents: DataFrame, text: str = "value", fields: str = "factor_expression string, status string") -> DataFrame:
    """factor_id and fields of the factors in JSON documents {"factors": {id: {...}}}."""
    parsed = F.from_json(F.col(text), f"struct<factors: map<string, struct<{fields}>>>")
    return documents.select(F.explode(parsed["factors"]).alias("factor_id", "_f")).select("factor_id", "_f.*")


def combined_factors(official: DataFrame, custom: DataFrame, least_quality: float, most: int) -> DataFrame:
    """factor_id, expression, origin: official factors, then the best custom ones by quality, `most` at most and none whose expression is official."""
    able = custom.where(F.col("quality") >= least_quality).join(official.select("expression"), "expression", "left_anti")
    best = able.orderBy(F.desc("quality"), "factor_id").limit(most)
    return official.select("factor_id", "expression", F.lit("official").alias("origin")).unionByName(best.select("factor_id", "expression", F.lit("custom").alias("origin")))


def published(wide: DataFrame, factors: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """trade_date (yyyyMMdd), instrument, factor_id, factor_value: no nulls, and of repeated keys the last in `order`, then the largest value."""
    long = wide.unpivot(["datetime", "instrument", *order], list(factors), "factor_id", "factor_value").where(finite("factor_value").isNotNull())
    keys = ["datetime", "instrument", "factor_id"]
    last = long.groupBy(*keys).agg(F.max_by("factor_value", F.struct(*order, "factor_value")).alias("factor_value"))
    return last.select(F.date_format("datetime", "yyyyMMdd").alias("trade_date"), "instrument", "factor_id", "factor_value")


def publish(wide: DataFrame, factors: Sequence[str], path: str, order: Sequence[str] = ()) -> DataFrame:
    """Writes `published` by factor, then its manifest, and reads it back."""
    published(wide, factors, order).write.mode("overwrite").partitionBy("factor_id").parquet(f"{path}/values")
    write_manifest(wide.sparkSession, f"{path}/manifest", {"version": 1, "factors": list(factors)})
    return wide.sparkSession.read.parquet(f"{path}/values")


def feature_columns(frame: DataFrame, keys: Sequence[str] = ("datetime", "instrument"), prefix: str = "feature_") -> DataFrame:
    return frame.withColumnsRenamed({c: f"{prefix}{c}" for c in frame.columns if c not in keys and not c.startswith(prefix)})


def metric_rows(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, metric, value (non-finite: null) of a wide frame of metrics."""
    return metrics.unpivot(list(keys), list(names), "metric", "value").withColumn("value", finite("value"))


def cumulative_excess(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., date, daily_excess_return, cumulative_excess_return of a daily report (return, bench, cost)."""
    excess = F.col("return") - F.col("bench") - F.col("cost")
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = report.select(*by, "date", excess.alias("daily_excess_return"))
    return rows.withColumn("cumulative_excess_return", F.sum("daily_excess_return").over(w))


def save_results(report: DataFrame, positions: DataFrame, metrics: dict[str, float], path: str) -> None:
    """Daily report, cumulative excess, positions, and the metrics (non-finite: 0) as a manifest, written last."""
    report.write.mode("overwrite").parquet(f"{path}/report")
    cumulative_excess(report).write.mode("overwrite").parquet(f"{path}/cumulative_excess")
    positions.write.mode("overwrite").parquet(f"{path}/positions")
    clean = {k: float(v) if v is not None and np.isfinite(v) else 0.0 for k, v in metrics.items()}
    write_manifest(report.sparkSession, f"{path}/metrics", {"version": 1, "metrics": clean})


def markdown_lines(frame: DataFrame, title: str, order: Sequence[str]) -> DataFrame:
    """line_no, line of a Markdown table of a small frame, under its title."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in frame.columns)), F.lit(" |"))
    body = frame.select((F.row_number().over(Window.orderBy(*order)) + 3).alias("line_no"), cells.alias("line"))
    head = [(1, f"# {title}"), (2, f"| {' | '.join(frame.columns)} |"), (3, f"|{'---|' * len(frame.columns)}")]
    return frame.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)


# --- binary series --------------------------------------------------------------


def binary_market(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, instruments: Sequence[str] | None = None) -> DataFrame:
    """datetime, instrument, open, high, low, close, volume, ret, vwap from a folder of binary series.

    calendars/day.txt has a date a line; features/<instrument>/<field>.day.bin
    holds little-endian 32-bit floats, the first being the calendar row at
    which the rest begin.  Rows without a finite close are left out; other
    fields default to the close, and volume and ret to 0.
    """
    days = spark.read.text(f"{root}/calendars/day.txt", wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda d: F.trim(d)), lambda d: d != "")).alias("i", "day"))
    days = days.select(F.col("i").cast("long").alias("i"), F.to_date("day").alias("datetime"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.day.bin").option("recursiveFileLookup", True).load(f"{root}/features")
    part = F.split("path", "/")
    named = files.select(F.upper(F.element_at(part, -2)).alias("instrument"), F.regexp_replace(F.element_at(part, -1), r"\.day\.bin$", "").alias("field"), "content")
    if instruments is not None:
        named = named.where(F.col("instrument").isin([i.upper() for i in instruments]))

    def decode(batches):
        for batch in batches:
            for instrument, field, raw in zip(batch.instrument, batch.field, batch.content, strict=True):
                x = np.frombuffer(raw[: len(raw) - len(raw) % 4], "<f4").astype(float)
                if len(x):
                    yield pd.DataFrame({"instrument": instrument, "field": field, "i": int(x[0]) + np.arange(len(x) - 1), "value": x[1:]})

    values = named.mapInPandas(decode, "instrument string, field string, i long, value double")
    fields = ["open", "high", "low", "close", "volume", "return"]
    wide = values.groupBy("instrument", "i").pivot("field", fields).agg(F.first("value")).where(finite("close").isNotNull()).join(days, "i")
    if start:
        wide = wide.where(F.col("datetime") >= F.lit(start).cast("date"))
    if end:
        wide = wide.where(F.col("datetime") <= F.lit(end).cast("date"))
    price = [F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")]
    return wide.select("datetime", "instrument", *price, "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("return", F.lit(0.0)).alias("ret"), F.col("close").alias("vwap"))


def with_benchmark(market: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there, and a benchmark row gives way to a market row of its key."""
    keys = ["datetime", "instrument"]
    return market.unionByName(benchmark.join(market.select(*keys), keys, "left_anti"), allowMissingColumns=True)


# --- tags -----------------------------------------------------------------------


def tags(text: Column, rules: dict[str, str]) -> Column:
    """Array of the tags whose patterns a text holds, in the rules' order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(t)) for t, p in rules.items())))


def bucket(name: Column, prefixes: dict[str, str], other: str = "other") -> Column:
    """The bucket of the first prefix that fits a name."""
    return F.coalesce(*(F.when(F.startswith(name, F.lit(p)), F.lit(b)) for p, b in prefixes.items()), F.lit(other))
