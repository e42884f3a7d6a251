"""Event log of a factor pool, its lifecycle, run records and the lookups over them.

The pool is an append-only log of rows (key, sequence, updated_at, created_at,
op, ...): the newest row of a key counts, and a delete among them hides it.
Writes go to new folders, and a snapshot is named by a manifest that is written
last, so that readers never see half of one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import create_once, newest_version
from .signal import expression_tokens, latest_events, token_jaccard

ORDER = ("sequence", "updated_at", "created_at")


class Conflict(RuntimeError):
    """The log has moved on from the version that a writer expected."""


class EventLog:
    """A log in a folder: delta folders, and a snapshot by buckets of keys into which compaction folds them.

    Every change commits a version, a file that must not exist yet, which names
    the folders in force; a writer that comes second commits on top of the
    first one's, so that several can write at once and none loses a delta.
    `buckets` counts when a log gets its first version and stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "expression_hash", buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _state(self) -> dict:
        empty = {"version": 0, "buckets": self.buckets, "snapshot": {}, "deltas": [], "archive": [], "streams": {}}
        return newest_version(self.spark, f"{self.path}/state") or empty

    def _commit(self, change: Callable[[dict], dict | None]) -> None:
        """Commits what `change` makes of the newest state, made anew for as long as others commit first; None commits nothing."""
        while True:
            state = self._state()
            changes = change(state)
            if changes is None:
                return
            new = state | changes | {"version": state["version"] + 1}
            if create_once(self.spark, f"{self.path}/state/v{new['version']:09d}.json", json.dumps(new, sort_keys=True)):
                return

    def version(self) -> int:
        return self._state()["version"]

    def append(self, rows: DataFrame, expected: int | None = None, stream: str | None = None, batch: int = 0) -> None:
        """Adds rows, checked against the schema, as a delta of their own.

        With `expected`, raises Conflict unless that is still the log's version
        when the rows are committed.  With a `stream`, a batch of it that is in
        the log already, or an earlier one, is not added again.
        """
        wanted = self.spark.createDataFrame([], self.schema).schema
        if {f.name for f in rows.schema} != {f.name for f in wanted}:
            raise ValueError(f"columns {sorted(rows.columns)} are not those of the log")
        if stream is not None and self._state()["streams"].get(stream, -1) >= batch:
            return
        delta = f"{self.path}/delta-{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in wanted)).write.parquet(delta)

        def add(state: dict) -> dict | None:
            if expected is not None and state["version"] != expected:
                raise Conflict(f"the log is at version {state['version']}, not {expected}")
            if stream is None:
                return {"deltas": [*state["deltas"], delta]}
            if state["streams"].get(stream, -1) >= batch:
                return None
            return {"deltas": [*state["deltas"], delta], "streams": state["streams"] | {stream: batch}}

        self._commit(add)

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        state = self._state()
        return self._read([*state["snapshot"].values(), *state["deltas"]])

    def _newest(self, rows: DataFrame) -> DataFrame:
        order = [F.desc(c) for c in ORDER if c in rows.columns]
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(self.key).orderBy(*order))).where("_r = 1").drop("_r")

    def effective(self) -> DataFrame:
        """The newest row of each key, unless it is a delete."""
        rows = self.rows()
        return latest_events(rows, self.key, [c for c in ORDER if c in rows.columns])

    def compact(self, keep: int = 1) -> list[str]:
        """Folds all deltas into the snapshot; returns the folders that no reader of the last `keep` snapshots needs any more.

        Only buckets of keys that the deltas hold are written again.  Deltas that
        come in meanwhile stay deltas; if another compaction commits first, this
        one is given up.  A delete stays in the snapshot, so that an older row
        of its key that arrives later does not bring the key back.
        """
        base = self._state()
        if not base["deltas"]:
            return []
        number = F.pmod(F.xxhash64(F.col(self.key)), F.lit(base["buckets"]))
        fresh = self._read(base["deltas"])
        touched = sorted(str(r.b) for r in fresh.select(number.alias("b")).distinct().collect())  # buckets at most
        old = [base["snapshot"][b] for b in touched if b in base["snapshot"]]
        folder = f"{self.path}/snapshot-{uuid.uuid4().hex}"
        self._newest(self._read([*old, *base["deltas"]])).withColumn("_bucket", number).write.partitionBy("_bucket").parquet(folder)
        unused: list[str] = []

        def fold(state: dict) -> dict | None:
            if state["snapshot"] != base["snapshot"]:
                return None
            archive = [*state["archive"], [*old, *base["deltas"]]]
            cut = max(0, len(archive) - keep)
            unused[:] = [p for some in archive[:cut] for p in some]
            left = [d for d in state["deltas"] if d not in base["deltas"]]
            return {"deltas": left, "snapshot": state["snapshot"] | {b: f"{folder}/_bucket={b}" for b in touched}, "archive": archive[cut:]}

        self._commit(fold)
        return unused

    def delete(self, keys: DataFrame, **values: Column) -> None:
        """Appends deletes of the keys that are there, one above the largest sequence."""
        self._restate(keys, op=F.lit("delete"), **values)

    def set_status(self, keys: DataFrame, status: str, column: str = "evaluation_status") -> None:
        """Appends rows that differ from the present ones in their status."""
        self._restate(keys, op=F.lit("upsert"), **{column: F.lit(status)})

    def _restate(self, keys: DataFrame, **values: Column) -> None:
        now = self.effective().join(keys.select(self.key).distinct(), self.key, "left_semi")
        top = self.rows().agg(F.max("sequence")).first()[0] or 0
        self.append(now.withColumns({"sequence": F.lit(top + 1).cast("long")} | values))


def expression_hash(expression: Column) -> Column:
    """The first 16 hex digits of SHA-256; null for a null or empty expression."""
    return F.when(F.length(expression) > 0, F.substring(F.sha2(expression, 256), 1, 16))


def with_defaults(payload: Column, defaults: dict[str, str]) -> Column:
    """A JSON object as a map of strings, with defaults for keys it lacks; a text that is no object counts as an empty one."""
    base = F.from_json(F.lit(json.dumps(defaults)), "map<string,string>")
    own = F.coalesce(F.from_json(payload, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def payload_json(values: Column) -> Column:
    """The map as JSON with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def versioned_update(current: DataFrame, changes: DataFrame, key: str = "factor_id") -> DataFrame:
    """key, applied, version, sequence, status of each change: applied if it names the present version, which then goes up by one.

    Of several changes of one version, the first by change_id is applied.
    """
    first = F.row_number().over(Window.partitionBy(key, "expected_version").orderBy("change_id")) == 1
    both = changes.withColumn("_first", first).join(current.select(key, "version", "sequence", "status"), key)
    ok = F.col("_first") & (F.col("expected_version") == F.col("version"))
    return both.select(key, "change_id", ok.alias("applied"), F.when(ok, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(ok, F.col("sequence") + 1).otherwise(F.col("sequence")).alias("sequence"), F.when(ok, F.col("new_status")).otherwise(F.col("status")).alias("status"), (ok & ~F.col("new_status").eqNullSafe(F.col("status"))).alias("logged"))


def ordinal_run_ids(runs: DataFrame, prefix: str, order: Sequence[str], day: str = "day") -> DataFrame:
    """runs with run_id: prefix, day and the run's number within the day, three digits at least."""
    number = F.row_number().over(Window.partitionBy(day).orderBy(*order)).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return runs.withColumn("run_id", F.concat_ws("_", F.lit(prefix), F.date_format(day, "yyyyMMdd"), padded))


def log_rows(log: DataFrame, factors: Sequence[str] | None = None, gate: str | None = None, between: tuple[str, str] | None = None, factor: str = "factor_id", at: str = "created_at") -> DataFrame:
    """Rows of a log by factor, gate and inclusive dates; all three reach the scan."""
    if factors is not None:
        log = log.where(F.col(factor).isin(list(factors)))
    if gate is not None:
        log = log.where(F.col("gate_name") == gate)
    if between:
        log = log.where((F.col(at) >= F.lit(between[0]).cast("timestamp")) & (F.col(at) < F.date_add(F.lit(between[1]).cast("date"), 1)))
    return log


def history_rows(metrics: DataFrame, series: Sequence[str], key: Sequence[str] = ("factor_id", "validated_at")) -> tuple[DataFrame, DataFrame]:
    """Summary rows with the md5 of their key as validation_id, and their array columns as long rows (validation_id, factor_id, metric_name, metric_index, metric_value)."""
    named = metrics.withColumn("validation_id", F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key))))
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("metric_name"), F.col(s).cast("array<double>").alias("values")) for s in series)))
    long = named.select("validation_id", "factor_id", pairs.alias("_p")).select("validation_id", "factor_id", "_p.metric_name", F.posexplode("_p.values").alias("metric_index", "metric_value"))
    return named.drop(*series), long


def latest_by_factor(history: DataFrame, order: Sequence[str], key: str = "factor_id") -> DataFrame:
    return history.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(o) for o in order)))).where("_r = 1").drop("_r")


# Statuses that are looked at again.
REVALIDATED = ["active", "candidate", "degraded"]


def revalidation_candidates(pool: DataFrame, today: str, days: int, statuses: Sequence[str] = REVALIDATED) -> DataFrame:
    """Factors of these statuses whose last validation is `days` old or more, or missing."""
    age = F.datediff(F.lit(today).cast("date"), F.to_date("last_validated"))
    return pool.where(F.col("status").isin(list(statuses)) & (age.isNull() | (age >= days)))


def impact_candidates(pool: DataFrame, buckets: Sequence[str], most: int, fallback: Sequence[str] = ("active",)) -> DataFrame:
    """Factors that depend on a changed bucket; if there are none, up to `most` of the fallback statuses in the order of their ids."""
    hit = pool.where(F.arrays_overlap("dependencies", F.array(*map(F.lit, buckets)))).withColumn("reason", F.lit("dependency"))
    if not hit.isEmpty():
        return hit
    return pool.where(F.col("status").isin(list(fallback))).orderBy("factor_id").limit(most).withColumn("reason", F.lit("fallback"))


# Statuses of the pool as the older registry names them, and those whose factors a model may use.
LEGACY_STATUS = {"draft": "pending_validation", "testing": "pending_validation", "candidate": "active", "watchlist": "stale", "core": "active", "satellite": "active", "degraded": "degraded", "retired": "deprecated", "blacklist": ""}
MODEL_ELIGIBLE = ["candidate", "core", "satellite", "degraded"]


def status_moves(events: DataFrame) -> DataFrame:
    """events with new_status (null where the event moves nothing), legacy_status and model_eligible.

    Columns: status, event, and what the event knows: gate_result, health_score,
    previous_health_score, health_confidence, tier, consecutive_failures, age_days.
    """
    status, event, tier = F.col("status"), F.col("event"), F.col("tier")
    health, before = F.coalesce("health_score", F.lit(0.0)), F.coalesce("previous_health_score", "health_score", F.lit(0.0))

    def at(*names: str) -> Column:
        return status.isin(list(names))

    moves = [
        ((event == "gate_failed") & (F.col("gate_result") == "blacklist"), "blacklist"),
        (at("draft") & (event == "calculation_completed"), "testing"),
        (at("testing") & (event == "gate_passed") & (F.col("gate_result") == "pass") & (health >= 40), "candidate"),
        (at("candidate") & (event == "tier_update") & ((tier == "A") | (health >= 80)), "core"),
        (at("candidate") & (event == "tier_update") & ((tier == "B") | (health >= 60)), "satellite"),
        (at("candidate") & (event == "tier_update") & ((tier == "C") | (health < 60) | (F.col("health_confidence") < 0.5)), "watchlist"),
        (at("core", "satellite") & (event == "health_score_update") & (before - health >= 20), "degraded"),
        (at("core", "satellite") & (event == "health_score_update") & (health > 40) & (health < 60), "watchlist"),
        (at("core") & (event == "health_score_update") & (health >= 60) & (health < 80), "satellite"),
        (at("satellite") & (event == "tier_update") & (tier == "A"), "core"),
        (at("degraded") & (event == "revalidation_failed") & (F.col("consecutive_failures") >= 3), "retired"),
        (at("degraded") & (event == "revalidation_passed"), "satellite"),
        (at("candidate") & (event == "timeout_check") & (F.col("age_days") >= 90) & (health < 60), "retired"),
        (at("watchlist") & (event == "timeout_check") & (F.col("age_days") >= 60), "retired"),
        (at("retired") & (event == "manual_revalidation_passed"), "watchlist"),
        (at("retired") & (event == "confirm_blacklist"), "blacklist"),
    ]
    new = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(to)) for c, to in moves))
    legacy = F.from_json(F.lit(json.dumps(LEGACY_STATUS)), "map<string,string>")
    out = events.withColumn("new_status", new)
    return out.withColumns({"legacy_status": F.try_element_at(legacy, F.col("new_status")), "model_eligible": F.coalesce(F.col("new_status").isin(MODEL_ELIGIBLE), F.lit(False))})


def lifecycle(validations: DataFrame, active: float = 0.5, degraded: float = 0.3, fails: int = 3, stale_days: int = 30, now: str | None = None) -> DataFrame:
    """factor_id, status, consecutive_failures, last_validated after all validations (factor_id, at, success, stability), replayed in order.

    A success makes a factor active from `active` stability on, degraded below
    `degraded`, and degraded between the two if it was active or pending; a
    failure degrades an active or stale one, `fails` in a row deprecate it.  An
    active one is stale stale_days after its last validation.  A factor's own
    history is one list.
    """
    rows = validations.groupBy("factor_id").agg(F.sort_array(F.collect_list(F.struct("at", "success", "stability"))).alias("history"))

    def step(state: Column, v: Column) -> Column:
        was, s = state["status"], v["stability"]
        good = F.when(s >= active, "active").when(s < degraded, "degraded").when((s < active) & was.isin("active", "pending_validation"), "degraded").otherwise(was)
        count = state["fails"] + 1
        bad = F.when(count >= fails, "deprecated").when(was.isin("active", "stale"), "degraded").otherwise(was)
        return F.struct(F.when(v["success"], good).otherwise(bad).alias("status"), F.when(v["success"], F.lit(0)).otherwise(count).cast("int").alias("fails"))

    start = F.struct(F.lit("pending_validation").alias("status"), F.lit(0).alias("fails"))
    out = rows.select("factor_id", F.aggregate("history", start, step).alias("s"), F.element_at("history", -1)["at"].alias("last_validated"))
    status = F.col("s.status")
    if now:
        status = F.when((status == "active") & (F.datediff(F.lit(now).cast("date"), "last_validated") >= stale_days), "stale").otherwise(status)
    return out.select("factor_id", status.alias("status"), F.col("s.fails").alias("consecutive_failures"), "last_validated")


# Priorities of the reasons to run a cycle.
TRIGGER_PRIORITY = {"manual": 1, "regime_switch": 2, "fhi_drop": 2, "data_update": 3, "revalidation_decay": 4, "new_factor_threshold": 5, "schedule": 6}


def triggers(signals: DataFrame, now: str, cooldown_minutes: int, by: str = "dataset") -> DataFrame:
    """by, reason, priority: of the signals (by, reason, last_triggered) out of their cooldown, that of the smallest priority, then the first listed."""
    place = F.from_json(F.lit(json.dumps({r: 100 * p + i for i, (r, p) in enumerate(TRIGGER_PRIORITY.items())})), "map<string,int>")
    free = F.col("last_triggered").isNull() | (F.col("last_triggered") <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {cooldown_minutes} MINUTES"))
    known = signals.where(free).withColumn("_p", F.try_element_at(place, F.col("reason"))).where("_p is not null")
    return known.groupBy(by).agg(F.min_by("reason", "_p").alias("reason"), F.floor(F.min("_p") / 100).cast("int").alias("priority"))


def best_runs(runs: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., run_id and value of the best run by a metric; ties to the smaller run_id."""
    return runs.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min_by(F.struct("run_id", F.col(metric).alias("value")), F.struct(-F.col(metric), "run_id")).alias("_b")).select(*by, "_b.run_id", "_b.value")


# --- lookups over the pool and its runs ---------------------------------------


def library_summary(pool: DataFrame) -> DataFrame:
    """kind, name, n: factors in all, by status and by phase, validated ones; and mean stability in `value`."""
    one = F.lit(None).cast("double")
    whole = pool.agg(F.count("*").alias("total"), F.count("last_validated").alias("validated"), F.avg("stability").alias("stability"))
    rows = whole.select(F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name"), F.col("total").alias("n"), one.alias("value")), F.struct(F.lit("validated").alias("kind"), F.lit("").alias("name"), F.col("validated").alias("n"), F.round("stability", 6).alias("value")))).alias("r")).select("r.*")
    for c in ("status", "phase"):
        rows = rows.unionByName(pool.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name"), "n", one.alias("value")))
    return rows


def audit_trail(log: DataFrame, factors: Sequence[str] | None, since: str | None, most: int) -> DataFrame:
    """The newest `most` entries of these factors since a date, newest first; entries equal in all of factor, at, action, actor, detail count once."""
    log = log_rows(log, factors, at="at")
    if since:
        log = log.where(F.col("at") >= F.lit(since).cast("timestamp"))
    return log.dropDuplicates(["factor_id", "at", "action", "actor", "detail"]).orderBy(F.desc("at"), "factor_id", "action", "actor", "detail").limit(most)


def active_factors(pool: DataFrame, status: Sequence[str] = ("active",), universe: str | None = None, horizon: str | None = None) -> DataFrame:
    """Factors of these statuses whose universes and horizons, given as arrays, hold the wanted ones."""
    out = pool.where(F.col("status").isin(list(status)))
    for c, wanted in (("universes", universe), ("horizons", horizon)):
        out = out.where(F.array_contains(c, wanted)) if wanted is not None else out
    return out


def factor_values(values: DataFrame, date: str, factors: Sequence[str], instruments: Sequence[str]) -> DataFrame:
    """Cells by three predicates that reach the scan."""
    return values.where((F.col("trade_date") == F.lit(date)) & F.col("factor_id").isin(list(factors)) & F.col("instrument").isin(list(instruments)))


def merged(pool: DataFrame, incoming: DataFrame, key: str | Sequence[str] = "factor_id") -> DataFrame:
    """Rows of both; where a key, of one column or several, is in both, the incoming one counts."""
    key = [key] if isinstance(key, str) else list(key)
    return incoming.unionByName(pool.join(incoming.select(*key), key, "left_anti"), allowMissingColumns=True)


def recent_runs(runs: DataFrame, most: int, cycle_type: str | None = None) -> DataFrame:
    out = runs.where(F.col("cycle_type") == cycle_type) if cycle_type else runs
    return out.orderBy(F.desc("started_at"), "run_id").limit(most)


def current_against_best(current: DataFrame, best: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, current, best, bigger (current, best, same or missing) for the wanted metrics in either."""
    both = current.select("metric", F.col("value").alias("current")).join(best.select("metric", F.col("value").alias("best")), "metric", "full_outer")
    side = F.when(F.col("current").isNull() | F.col("best").isNull(), "missing").when(F.col("current") > F.col("best"), "current").when(F.col("current") < F.col("best"), "best").otherwise("same")
    return both.where(F.col("metric").isin(list(metrics))).withColumn("bigger", side)


def failure_codes(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with codes: those of the rules that hold, in their order."""
    return rows.withColumn("codes", F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in rules.items()))))


def failure_counts(coded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., code, n, and the share of by's rows; rows without a code are counted as OK."""
    code = F.explode(F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit("OK"))))
    counts = coded.select(*by, code.alias("code")).groupBy(*by, "code").agg(F.count("*").alias("n"))
    total = coded.groupBy(*by).agg(F.count("*").alias("_total"))
    both = counts.join(total, list(by)) if by else counts.crossJoin(total)  # one row
    return both.select(*by, "code", "n", (F.col("n") / F.col("_total")).alias("share"))


def merged_feedback(old: DataFrame, new: DataFrame, most: int, key: Sequence[str] = ("factor_id", "stage", "error_type", "message")) -> DataFrame:
    """Entries of both, the newest of each key, and of these the newest `most`."""
    both = old.unionByName(new)
    latest = both.groupBy(*key).agg(F.max("at").alias("at"))
    return latest.orderBy(F.desc("at"), *key).limit(most)


def text_search(pool: DataFrame, query: str, k: int, min_score: float = 0.0, fields: Sequence[str] = ("expression", "description")) -> DataFrame:
    """factor_id, score (4 digits): the best Jaccard of words over the fields, the k largest; ties by id."""
    words = expression_tokens(F.lit(query))
    score = F.greatest(*(token_jaccard(expression_tokens(F.coalesce(f, F.lit(""))), words) for f in fields), F.lit(0.0))
    return pool.select("factor_id", F.round(score, 4).alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), "factor_id").limit(k)


def common_patterns(pool: DataFrame, dimensions: Sequence[str], k: int = 3) -> DataFrame:
    """dimension, tag, n, rank: the k most frequent tags of each array column; ties by tag."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("tags")) for d in dimensions)))
    counts = pool.select(pairs.alias("_p")).select("_p.dimension", F.explode("_p.tags").alias("tag")).groupBy("dimension", "tag").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "tag"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def operator_frequency(pool: DataFrame, expression: str = "expression") -> DataFrame:
    """operator, n: how often names stand before an opening parenthesis, over all expressions."""
    names = F.regexp_extract_all(F.upper(expression), F.lit(r"([A-Z_][A-Z_0-9]*)\s*\("), F.lit(1))
    return pool.select(F.explode(names).alias("operator")).groupBy("operator").agg(F.count("*").alias("n"))


def labelled_curve(curve: DataFrame, value: str, limits: dict[str, float], lowest: str = "poor") -> DataFrame:
    """date, value and its label: the first of the descending limits that it reaches."""
    label = F.coalesce(*(F.when(F.col(value) >= x, F.lit(name)) for name, x in sorted(limits.items(), key=lambda p: -p[1])), F.lit(lowest))
    return curve.select("date", F.col(value).alias("value"), label.alias("label"))


# --- selections ---------------------------------------------------------------


def page(rows: DataFrame, search: str | None, columns: Sequence[str], order: Sequence[Column], offset: int, limit: int) -> tuple[DataFrame, int]:
    """A page of the rows in which a column holds the search text, and how many such rows there are."""
    if search:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(search.lower())), F.lit(False))
        rows = rows.where(hit)
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def parents(trajectories: DataFrame, n: int, metric: str = "metric", stability: str = "stability") -> DataFrame:
    """The n trajectories of largest stability, then metric, then smallest id; those without a metric never."""
    return trajectories.where(F.col(metric).isNotNull()).orderBy(F.desc_nulls_last(stability), F.desc(metric), "id").limit(n)


def crossover_pairs(pool: DataFrame, most: int, how: str = "best_sum", seed: int = 0) -> DataFrame:
    """a, b, total: pairs of a bounded pool of parents, by the sum of their metrics, across directions first, or at random.

    The pool is what a selection left; every pair of it is formed, and `most` stay.
    """
    a, b = (pool.select(F.col("id").alias(x), F.col("direction").alias(f"_d{x}"), F.col("metric").alias(f"_m{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("total", F.col("_ma") + F.col("_mb"))
    first = {"best_sum": [F.desc("total")], "across_first": [F.col("_da") == F.col("_db"), F.desc("total")], "random": [F.xxhash64(F.lit(seed), "a", "b")]}[how]
    return pairs.orderBy(*first, "a", "b").limit(most).select("a", "b", "total")


def multi_objective(pool: DataFrame, total: int, shares: Sequence[tuple[str, float]] = (("performance", 0.5), ("novelty", 0.3), ("simplicity", 0.2)), statuses: Sequence[str] = ("active", "candidate")) -> DataFrame:
    """id, bucket: each objective in turn takes its share of `total` from those not taken yet; performance fills what is left.

    Only the best 2 * total of each objective can be picked, so no more are ranked together.
    """
    able = pool.where(F.col("status").isin(list(statuses))).select("id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c, _ in shares))
    counts = [max(1, round(total * s)) for _, s in shares[:-1]]
    counts.append(max(1, total - sum(counts)))
    taken: DataFrame | None = None
    for (c, _), n in zip([*shares, shares[0]], [*counts, total], strict=True):
        left = able if taken is None else able.join(taken.select("id"), "id", "left_anti")
        room = n if taken is None else min(n, total - taken.count())  # a few rows
        if room <= 0:
            break
        best = left.orderBy(F.desc(c), "id").limit(room).select("id", F.lit(c).alias("bucket"))
        rows = [tuple(r) for r in best.collect()]  # at most total
        made = pool.sparkSession.createDataFrame(rows, best.schema)
        taken = made if taken is None else taken.unionByName(made)
    return taken


def latest_of_direction(trajectories: DataFrame) -> DataFrame:
    """direction, id of its newest trajectory; ties to the larger id."""
    return trajectories.groupBy("direction").agg(F.max_by("id", F.struct("at", "id")).alias("id"))
