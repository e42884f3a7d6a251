"""Structured Streaming counterparts: incremental daily panel, sessions, late data, upsert sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.store import EventLog
from ..storage import read_manifest, scratch, write_manifest


def arriving(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; changed files are not read again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def finished(frame: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all there is, into a Parquet folder of the shared folder, and reads its rows.

    The folder's own log makes each batch count once; rows that still wait for a
    later watermark are not in it.
    """
    spark, path = frame.sparkSession, scratch(frame.sparkSession, name)
    options = {"path": f"{path}/rows", "checkpointLocation": f"{path}/progress"}
    frame.writeStream.format("parquet").options(**options).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")


def sliding_counts(events: DataFrame, group: str, length: str, slide: str, late: str) -> DataFrame:
    """Count and sum by group and sliding window, each row in every window that holds it, final when the watermark has passed the window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), group).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def daily_panel(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The events panel by user and day, final when the watermark has passed the day."""
    day, order = F.window("ts", "1 day"), F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late)
        .groupBy(day, F.col("user_id").cast("string").alias("instrument"))
        .agg(F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").cast("double").alias("volume"), (F.sum("value") / F.count("*")).alias("vwap"))
        .select(F.to_date("window.start").alias("datetime"), "instrument", "open", "close", "high", "low", "volume", "vwap")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by user with their events' count and sum."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(changes: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Changes without repeats of a key within the watermark."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def append_log(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every batch to a log partitioned by batch; a batch that is run again replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(changes: DataFrame, routes: dict[str, list[str]], late: str = "1 day") -> DataFrame:
    """changes (dataset, change_type, ts) with the workflows they start; a dataset and type counts once within the watermark."""
    table = F.from_json(F.lit(json.dumps(routes)), "map<string,array<string>>")
    fresh = once(changes.withColumn("dedupe_key", F.concat_ws(":", "dataset", "change_type")), ["dedupe_key"], late)
    return fresh.withColumn("workflows", F.coalesce(F.try_element_at(table, F.col("dataset")), F.array().cast("array<string>")))


def cycle(changes: DataFrame, steps: dict[str, Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Runs the steps, in order, on every batch that has rows; a batch that failed is run again from its first step."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            for step in steps.values():
                step(batch)
        batch.unpersist()

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker(calls: DataFrame, fails: int = 3, cooldown_seconds: int = 300) -> DataFrame:
    """service, ts, ok, state, let_through of calls (service, ts, ok): a circuit breaker for each service.

    closed lets calls through; `fails` failures in a row open it; after the
    cooldown one call is let through (half_open), whose outcome closes or opens
    it again.  State is kept by Spark for each service; calls count in the order
    of their times within a batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, opened = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(rows.ts, rows.ok, strict=True):
            waiting = opened is not None and ts.timestamp() < opened + cooldown_seconds
            name = "open" if waiting else "half_open" if opened is not None else "closed"
            if not waiting:
                count = 0 if ok else count + 1
                if ok:
                    opened = None
                elif opened is not None or count >= fails:
                    opened = ts.timestamp()
            out.append((key[0], ts, bool(ok), name, not waiting))
        state.update((count, opened))
        yield pd.DataFrame(out, columns=["service", "ts", "ok", "state", "let_through"])

    schema = "service string, ts timestamp, ok boolean, state string, let_through boolean"
    return calls.groupBy("service").applyInPandasWithState(run, schema, "count int, opened double", "append", GroupStateTimeout.NoTimeout)


def keep_best(trajectories: DataFrame, path: str, checkpoint: str, most: int) -> StreamingQuery:
    """A pool of the `most` best trajectories (id, metric) seen, written anew under a new version with every batch, so that readers always find a whole one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = read_manifest(spark, f"{path}/state")
        if state and state["batch"] >= number:
            return  # this batch is in the pool already
        rows = batch.select("id", "metric")
        if state:
            rows = rows.unionByName(spark.read.parquet(state["pool"]))
        best = rows.groupBy("id").agg(F.max("metric").alias("metric")).orderBy(F.desc("metric"), "id").limit(most)
        best.write.mode("overwrite").parquet(f"{path}/pool-{number:09d}")
        write_manifest(spark, f"{path}/state", {"version": number + 1, "batch": number, "pool": f"{path}/pool-{number:09d}"})

    return trajectories.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pool_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(read_manifest(spark, f"{path}/state")["pool"])


def visible_events(panel: DataFrame, events: DataFrame, days: int, late: str = "7 days") -> DataFrame:
    """Streams of panel rows (instrument, ts) and of events (instrument, happened, visible), joined where an event of the last `days` days is visible.

    Event time of an event is when it became visible; both sides drop what comes
    later than `late`.
    """
    left = panel.withWatermark("ts", late).alias("p")
    right = events.withWatermark("visible", late).alias("e")
    near = F.expr(f"p.instrument = e.instrument AND e.visible <= p.ts AND e.visible > p.ts - INTERVAL {days} DAYS AND e.happened > p.ts - INTERVAL {days} DAYS AND e.happened <= p.ts")
    return left.join(right, near).select("p.instrument", "p.ts", "e.happened", "e.visible")


def upsert_log(changes: DataFrame, log: EventLog, checkpoint: str, compact_every: int = 10) -> StreamingQuery:
    """Appends every batch to an event log and folds it into a snapshot every few batches.

    The log keeps the number of the stream's last batch, so one that is run again
    after a failure is not appended twice.  The stream is known by its checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            log.append(batch, stream=checkpoint, batch=number)
        if number % compact_every == compact_every - 1:
            log.compact()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
