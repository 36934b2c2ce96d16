"""Queries for streaming (STR1-4) and the table form of preprocessing (TXT14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.operators import language as L
from verba.plans import classify as C
from verba.plans import q_models as QM
from verba.plans.q_jobs import JOBS_SQL, RESULTS_SQL
from verba.session import materialize
from verba.sources import tables as TB
from verba.sources.tables import load
from verba.streaming import streams as ST


def q_preprocess_text(spark, sf):
    docs = TB.cleaned_documents(spark, sf)
    d = C.preprocess_table(spark, sf, docs, L.language_profiles(spark, sf, docs), TB.translations(spark, sf, docs))
    processed = F.when(F.col("blank"), F.lit("")).otherwise(F.col("model_text"))
    return d.select(F.col("id").alias("doc_id"), "language", F.sha2(processed, 256).alias("text_hash"))


def q_stream_classify(spark, sf):
    r = ST.stream_classify(spark, sf, load(spark, sf, "documents"), translations=TB.translations(spark, sf))
    return r.select("doc_id", "prediction", SC.round6("confidence").alias("confidence"), "language", "is_ensemble",
                    "models_used")


def q_stream_job_progress(spark, sf):
    res = TB.result_rows(spark, sf).select("job_id", "error_message", "created_at")
    # static side of the stream-static join: computed once, not once per micro-batch
    totals = materialize(TB.jobs(spark, sf).select("job_id", "total_rows"))
    r = ST.stream_job_progress(spark, res, totals)
    return r.select("job_id", "processed_rows", "failed_rows", "total_rows", SC.round6(F.col("processed_rows") * 100.0 / F.col("total_rows")).alias("progress_pct"),
                    (F.col("state") == "completed").alias("is_complete"))


def q_stream_dedupe_jobs(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return ST.stream_dedupe(spark, ev)


def q_stream_retry_safe_sink(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "ts", "value")
    return ST.stream_retry_safe_sink(spark, ev)


QUERIES = {
    "preprocess_text": q_preprocess_text,
    "stream_classify": q_stream_classify,
    "stream_job_progress": q_stream_job_progress,
    "stream_dedupe_jobs": q_stream_dedupe_jobs,
    "stream_retry_safe_sink": q_stream_retry_safe_sink,
}


def _preprocess_sql():
    full = QM._classify_sql()
    head = full[: full.rindex(",\nsrc AS MATERIALIZED")]
    return head.rstrip().rstrip(",") + (
        "\nSELECT id AS doc_id, language, sha256(" + QM.S.normalize_text("translated") + ") AS text_hash FROM tx")


ORACLES = {
    "preprocess_text": _preprocess_sql(),
    "stream_classify": QM.ORACLES["classify_table"],
    "stream_job_progress": (
        # two deliveries by time: a job whose total the first one reaches is ended by it
        f"WITH r AS {RESULTS_SQL}, b AS (SELECT epoch_us(min(created_at)) AS lo, epoch_us(max(created_at)) AS hi FROM r), "
        "d AS (SELECT r.*, (epoch_us(created_at) - lo) < (hi - lo) // 2 + 1 AS first FROM r, b), "
        "a AS (SELECT d.job_id, max(j.total_rows) AS total_rows, count(*) AS n, count(*) FILTER (WHERE first) AS n1, count(error_message) AS f, "
        f"count(error_message) FILTER (WHERE first) AS f1 FROM d JOIN {JOBS_SQL} j USING (job_id) GROUP BY d.job_id), "
        "x AS (SELECT job_id, total_rows, CASE WHEN n1 >= total_rows THEN n1 ELSE n END AS processed_rows, CASE WHEN n1 >= total_rows THEN f1 ELSE f END "
        "AS failed_rows FROM a) SELECT job_id, processed_rows, failed_rows, total_rows, round(processed_rows * 100.0 / total_rows, 6) AS progress_pct, "
        "processed_rows >= total_rows AS is_complete FROM x"),
    "stream_dedupe_jobs": "SELECT event_id, ts, user_id, event_type FROM events",
    "stream_retry_safe_sink": "SELECT event_id, ts, value FROM events",
}
