"""Streams run over whole tables to their end, with SQL twins that know the last watermark.

All files of a table make one batch here, so that no row is late; what the
watermark has not passed at the end is not final and not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import streaming as st
from ..operators.store import EventLog
from ..storage import scratch
from .analytics import query
from .language import rounded, rounded_sql
from .pool import _LOG, LOG_SCHEMA, LOG_SQL

ALL_FILES = (1 << 31) - 1


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # a pattern, as a table may be one file, which a stream takes only so
    out = st.arriving(spark, f"{sf_dir}/{name}.parque[t]", spark.read.parquet(path).schema, ALL_FILES)
    # event time must be a point in time; tables have it without a zone
    return out.withColumns({c: F.col(c).cast("timestamp") for c, kind in out.dtypes if kind == "timestamp_ntz"})


def _plain(c: Column) -> Column:
    return c.cast("timestamp_ntz")


MARK = "(SELECT date_trunc('milliseconds', CAST(max(ts) AS TIMESTAMP)) FROM events)"


@query(f"""SELECT CAST(ts AS DATE) AS datetime, CAST(user_id AS VARCHAR) AS instrument,
arg_min(value, {{'a': ts, 'b': event_id}}) AS open, arg_max(value, {{'a': ts, 'b': event_id}}) AS close, max(value) AS high,
min(value) AS low, CAST(count(*) AS DOUBLE) AS volume, {rounded_sql("sum(value) / count(*)")} AS vwap
FROM events GROUP BY 1, 2 HAVING CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= {MARK} - INTERVAL 2 DAY""")
def stream_daily_panel(spark, sf_dir):
    """The daily panel as a stream, of the days that are final."""
    out = st.finished(st.daily_panel(_stream(spark, sf_dir, "events"), "2 days"), "daily-panel")
    return out.withColumn("vwap", rounded(F.col("vwap")))


@query(f"""WITH e AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS started, max(ts) AS last_ts, count(*) AS n, {rounded_sql("sum(value)")} AS total
FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {MARK} - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf_dir):
    """Sessions by user with a gap of 30 minutes, of those that can grow no more."""
    out = st.finished(st.sessions(_stream(spark, sf_dir, "events")), "sessions")
    ended = _plain(F.col("session_window.end") - F.expr("INTERVAL 30 MINUTES")).alias("last_ts")
    return out.select("user_id", _plain(F.col("session_window.start")).alias("started"), ended, "n", rounded(F.col("total")).alias("total"))


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') - to_hours(2 * i) AS started, event_type, value
FROM events, (SELECT unnest([0, 1, 2]) AS i))
SELECT started, event_type, count(*) AS n, {rounded_sql("sum(value)")} AS total FROM w GROUP BY 1, 2
HAVING started + INTERVAL 6 HOUR <= {MARK} - INTERVAL 1 DAY""")
def stream_sliding_counts(spark, sf_dir):
    """Windows of six hours, one every two, by type of event."""
    out = st.finished(st.sliding_counts(_stream(spark, sf_dir, "events"), "event_type", "6 hours", "2 hours", "1 day"), "sliding")
    return out.select(_plain(F.col("window.start")).alias("started"), "event_type", "n", rounded(F.col("total")).alias("total"))


@query(f"WITH {LOG_SQL} SELECT factor_id, evaluation_status, sequence FROM ef")
def stream_upserts(spark, sf_dir):
    """A stream of changes into the event log, folded after each batch; what is in force at its end."""
    log = EventLog(spark, scratch(spark, "stream-log"), LOG_SCHEMA)
    changes = _stream(spark, sf_dir, "orders").selectExpr(*_LOG)
    st.upsert_log(changes, log, scratch(spark, "stream-progress"), compact_every=1).awaitTermination()
    return log.effective().select("factor_id", "evaluation_status", "sequence")


@query("""WITH r AS (SELECT o_custkey AS id, max(o_totalprice) AS metric FROM orders GROUP BY 1)
SELECT id, metric FROM r ORDER BY metric DESC, id LIMIT 50""")
def stream_best_pool(spark, sf_dir):
    """The pool of the 50 best customers by their largest order, kept by a stream."""
    path = scratch(spark, "stream-pool")
    rows = _stream(spark, sf_dir, "orders").selectExpr("o_custkey AS id", "o_totalprice AS metric")
    st.keep_best(rows, path, f"{path}/progress", 50).awaitTermination()
    return st.pool_of(spark, path)
