"""Streams: stream = batch for classification, exactly-once sink across a restart, dedupe."""

from harness import compare
from verba.plans import catalog

Q = catalog.queries()
O = catalog.oracles()


def test_stream_classify_equals_batch(spark, sf, duck_small):
    r = compare(Q["stream_classify"](spark, sf), duck_small, O["classify_table"])
    assert r["hash_match"], r


def test_retry_safe_sink_exactly_once(spark, sf):
    out = Q["stream_retry_safe_sink"](spark, sf)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert out.count() == n == out.select("event_id").distinct().count()


def test_dedupe_drops_redelivery(spark, sf, duck_small):
    r = compare(Q["stream_dedupe_jobs"](spark, sf), duck_small, O["stream_dedupe_jobs"])
    assert r["hash_match"], r


def test_stream_job_progress_final_state(spark, sf, duck_small):
    r = compare(Q["stream_job_progress"](spark, sf), duck_small, O["stream_job_progress"])
    assert r["hash_match"], r
