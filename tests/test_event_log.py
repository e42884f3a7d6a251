"""The event log under several writers, repeated batches and compaction."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewell import streaming
from tidewell.operators.store import Conflict, EventLog
from tidewell.plans import QUERIES
from tidewell.storage import create_once, newest_version

SCHEMA = "expression_hash string, sequence long, op string"


def log_at(spark, tmp_path):
    return EventLog(spark, f"file://{tmp_path}/log", SCHEMA)


def rows(spark, *given):
    return spark.createDataFrame(given, SCHEMA)


def test_one_writer_gets_a_name(spark, tmp_path):
    path = f"file://{tmp_path}/state/v000000001.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: create_once(spark, path, f'{{"writer": {i}}}'), range(8)))
    assert sum(won) == 1
    assert newest_version(spark, f"file://{tmp_path}/state") == {"writer": won.index(True)}
    assert [p.name for p in (tmp_path / "state").iterdir() if not p.name.startswith(".")] == ["v000000001.json"]


def test_concurrent_writers_lose_no_delta(spark, tmp_path):
    def write(w):
        log = log_at(spark, tmp_path)
        for i in range(4):
            log.append(rows(spark, (f"{w}-{i}", i, "upsert")))
            if w == 0:
                log.compact()

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    log = log_at(spark, tmp_path)
    assert {r.expression_hash for r in log.effective().collect()} == {f"{w}-{i}" for w in range(3) for i in range(4)}
    log.compact()
    assert log.rows().count() == 12 and log._state()["deltas"] == []


def test_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    log = log_at(spark, tmp_path)
    log.append(spark.range(1000).select(F.col("id").cast("string").alias("expression_hash"), F.lit(1).alias("sequence"), F.lit("upsert").alias("op")))
    log.compact()
    before = log._state()["snapshot"]
    assert len(before) == 16
    log.append(rows(spark, ("7", 2, "upsert"), ("7", 3, "upsert")))
    log.compact()
    after = log._state()["snapshot"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and spark.read.parquet(after[changed[0]]).count() < 150
    assert log.rows().count() == 1000
    assert log.compact() == []  # nothing to fold


def test_deletes_outlive_compaction(spark, tmp_path):
    log = log_at(spark, tmp_path)
    log.append(rows(spark, ("a", 1, "upsert"), ("a", 5, "delete"), ("b", 1, "upsert"), (None, 1, "upsert")))
    log.compact()
    log.append(rows(spark, ("a", 3, "upsert")))  # older than the delete
    assert {r.expression_hash for r in log.effective().collect()} == {"b", None}
    log.append(rows(spark, ("a", 6, "upsert")))
    assert {r.expression_hash for r in log.effective().collect()} == {"a", "b", None}


def test_a_moved_log_is_a_conflict(spark, tmp_path):
    log, other = log_at(spark, tmp_path), log_at(spark, tmp_path)
    seen = log.version()
    other.append(rows(spark, ("a", 1, "upsert")))
    with pytest.raises(Conflict):
        log.append(rows(spark, ("b", 1, "upsert")), expected=seen)
    log.append(rows(spark, ("b", 1, "upsert")), expected=log.version())
    assert log.effective().count() == 2


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    log = log_at(spark, tmp_path)
    for _ in range(2):
        log.append(rows(spark, ("a", 1, "upsert")), stream="s", batch=4)
    log.append(rows(spark, ("a", 2, "upsert")), stream="t", batch=4)
    assert log.rows().count() == 2


def test_a_stream_that_fails_after_its_append_goes_on(spark, tmp_path):
    path = str(tmp_path / "in")
    rows(spark, ("a", 1, "upsert"), ("b", 1, "upsert")).coalesce(1).write.parquet(path)

    class Failing(EventLog):
        def compact(self, keep=1):
            raise RuntimeError("lost after the append")

    def run(log):
        q = streaming.upsert_log(streaming.arriving(spark, path, SCHEMA), log, str(tmp_path / "k"), 1)
        q.awaitTermination(120)

    with pytest.raises(Exception, match="lost after the append"):
        run(Failing(spark, f"file://{tmp_path}/log", SCHEMA))
    log = log_at(spark, tmp_path)
    run(log)
    assert sorted(r.expression_hash for r in log.rows().collect()) == ["a", "b"]


def test_added_factors_leave_those_of_a_pool_beyond_a_million(spark, tmp_path):
    parts = [(5, 50), (1_000_005, 10), (1_000_006, 46)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.factor_id, r.origin, r.p_size) for r in QUERIES["library_merge"](spark, str(tmp_path)).collect())
    assert got == [(5, "new", 50), (1_000_005, "new", 50), (1_000_005, "old", 10), (1_000_006, "new", 46), (2_000_006, "new", 46)]
