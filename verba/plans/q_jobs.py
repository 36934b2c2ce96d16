"""Queries and DuckDB oracles for batch jobs (BAT1-10), queue tables (QUE1-6),
sources (SRC1-4) and sinks (SNK1-4)."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.operators import history as H
from verba.operators import jobs as J
from verba.sources import io as IO
from verba.sources import tables as TB
from verba.sources.commits import CommittedTable
from verba.sources.tables import load

AS_OF_LIVE = "1998-08-02 00:00:00"
AS_OF_CLEAN = "2001-08-01 00:00:00"
SIZE = 16
BATCH = 4  # for batch progress: a job has up to seven results
# Queues of the stand-in (order priorities) plus one that never gets a job.
QUEUE_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "batch"]
# Stand-in queue -> the reference queue whose time limit applies.
QUEUE_KIND = {"1-URGENT": "classification", "2-HIGH": "classification", "3-MEDIUM": "batch_processing",
              "4-NOT SPECIFIED": "csv_processing", "5-LOW": "csv_processing"}

# ------------------------------------------------------------------ SQL stand-ins (FIXTURES §3)

JOBS_SQL = """(SELECT o_orderkey AS job_id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
  o_orderpriority AS queue, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(CAST(o_orderkey % 4000 AS BIGINT)) END AS ended_at,
  o_totalprice, [1, 4, 8, 16, 64, 128, 256][o_orderkey % 7 + 1] AS batch_size,
  CAST(trunc(o_totalprice / 1000) AS BIGINT) + 1 AS total_rows,
  CASE o_orderstatus WHEN 'F' THEN CAST(trunc(o_totalprice / 1000) AS BIGINT) + 1
    WHEN 'P' THEN (CAST(trunc(o_totalprice / 1000) AS BIGINT) + 1) // 2
    ELSE (CAST(trunc(o_totalprice / 1000) AS BIGINT) + 1) // 3 END AS processed_rows
  FROM orders)"""

QJOBS_SQL = """(SELECT o_orderkey AS job_id, o_orderpriority AS queue,
  CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'queued'
    WHEN o_orderstatus = 'O' THEN 'started' WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'scheduled' END AS status,
  o_orderdate AS created_at, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(CAST(o_orderkey % 4000 AS BIGINT)) END AS ended_at,
  o_totalprice, printf('total=%.2f', o_totalprice) AS result, NULL::VARCHAR AS failure_info,
  CAST(trunc(o_totalprice / 1000) AS BIGINT) + 1 AS total FROM orders)"""

RESULTS_SQL = """(SELECT l_orderkey AS job_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS row_index,
  l_linenumber, l_returnflag AS prediction, 1 - l_discount AS confidence, l_tax AS processing_time,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 'model failed' END AS error_message,
  l_shipdate AS created_at, l_linestatus, l_quantity, l_partkey FROM lineitem)"""

HIST_SQL = """(SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, props AS text,
  event_type AS prediction, value / 500 AS confidence, ts AS created_at, value FROM events)"""

USERS_SQL = """(SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email, c_name AS full_name,
  c_acctbal >= 0 AS is_active FROM customer)"""


def _values(rows, cols):
    from verba.plans.sql_models import values
    return values(rows, cols)


def _ceil_div(a, b):
    return f"(({a}) + ({b}) - 1) // ({b})"


# ------------------------------------------------------------------ BAT

def q_assign_batches(spark, sf):
    d = IO.assign_row_index(load(spark, sf, "documents").select("doc_id"), ["doc_id"])
    n = load(spark, sf, "documents").count()
    return J.assign_batches(d, size=SIZE, total_rows=F.lit(n)).select("doc_id", "row_index", "batch", "total_batches")


def _batches(spark, sf):
    """Rows per batch, from counts alone: batch b of a job with n results holds rows (b - 1) * SIZE onwards.
    Every fifth job's first batch failed: it wrote nothing."""
    n = TB.result_rows(spark, sf).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    per = n.withColumn("batch", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / BATCH))))
    rows = F.least(F.col("n") - (F.col("batch") - 1) * BATCH, F.lit(BATCH))
    failed = (F.col("job_id") % 5 == 0) & (F.col("batch") == 1)
    return per.select("job_id", "batch", F.when(failed, 0).otherwise(rows).cast("long").alias("in_batch"))


def q_batch_progress(spark, sf):
    r = J.batch_progress(TB.jobs(spark, sf), _batches(spark, sf))
    return r.select("job_id", "batch", "processed_rows", "total_rows", SC.round6("progress_pct").alias("progress_pct"))


def q_job_status_live(spark, sf):
    r = J.job_status_live(TB.jobs(spark, sf), TB.result_rows(spark, sf), AS_OF_LIVE)
    return r.select("job_id", "status", "processed_rows", "total_rows", SC.round6("progress_pct").alias("progress_pct"),
                    "current_batch", "total_batches", F.round("eta_seconds", 3).alias("eta_seconds"))


def q_job_status_stored(spark, sf):
    r = J.job_status_stored(TB.jobs(spark, sf))
    return r.select("job_id", "status", "processed_rows", "total_rows", SC.round6("progress_pct").alias("progress_pct"),
                    "current_batch", "total_batches", "eta_seconds")


def q_job_results(spark, sf):
    r = J.job_results(TB.jobs(spark, sf), TB.results(spark, sf))
    return r.select("job_id", "status", "row_index", "prediction", SC.round6("confidence").alias("confidence"))


def q_job_errors(spark, sf):
    res = TB.results(spark, sf)
    failed_batch = (F.col("l_linestatus") == "F") & (F.col("job_id") % 50 == 0)
    return J.job_errors(res, failed_batch, F.lit("timeout"))


def q_job_transitions(spark, sf):
    return J.job_transitions(TB.jobs(spark, sf), TB.result_rows(spark, sf))


def q_batch_summary(spark, sf):
    c = load(spark, sf, "conversations")
    from verba.functions import text as T
    failed = (c.text.isNull() | (F.length(T.strip_ws(F.col("text"))) == 0) | (F.length("text") > 10000)
              | (F.col("role") == "system"))
    return J.batch_summary(c, "conv_id", failed, F.col("turn") + 1)


def q_per_row_time(spark, sf):
    r = J.per_row_time(TB.results(spark, sf), SIZE)
    return r.select("job_id", "row_index", "batch", SC.round6("per_row_time").alias("per_row_time"))


def q_delete_job_cascade(spark, sf):
    jobs = TB.jobs(spark, sf)
    _kept_jobs, kept_results = J.delete_job_cascade(jobs, TB.results(spark, sf), jobs.filter(F.col("status") == "failed"))
    return kept_results.select("job_id", "row_index")


# ------------------------------------------------------------------ QUE

def _queues(spark):
    return spark.createDataFrame([(q,) for q in QUEUE_NAMES], "queue string")


def q_queue_info(spark, sf):
    return J.queue_info(TB.queue_jobs(spark, sf), _queues(spark))


def q_batch_job_progress(spark, sf):
    return J.fold_job_events(TB.job_events(spark, sf))


def q_job_status_view(spark, sf):
    o = load(spark, sf, "orders").filter(F.col("o_orderkey") % 100 == 0)
    req = o.select(F.col("o_orderkey").alias("job_id")).unionByName(o.select((-1 - F.col("o_orderkey")).alias("job_id")))
    v = J.job_status_view(req, TB.queue_jobs(spark, sf))
    return v.select("*", F.concat_ws(" ", "progress.status", "progress.processed", "progress.total", "progress.percentage").alias("noted")).drop("progress")


def q_job_result_if_done(spark, sf):
    return J.job_result_if_done(TB.queue_jobs(spark, sf))


def q_clean_old_jobs(spark, sf):
    per_queue, _survivors = J.clean_old_jobs(TB.queue_jobs(spark, sf), _queues(spark), AS_OF_CLEAN, 7)
    return per_queue


def _limits(spark):
    rows = [(q, J.QUEUE_TIMEOUTS[k]) for q, k in QUEUE_KIND.items()]
    return spark.createDataFrame(rows, "queue string, limit_seconds int")


def q_jobs_over_timeout(spark, sf):
    return J.jobs_over_timeout(TB.queue_jobs(spark, sf), _limits(spark))


def q_job_step_progress(spark, sf):
    ev = load(spark, sf, "events").select(F.col("user_id").alias("job"), (F.col("event_id") % 3 + 1).alias("step"), "ts")
    return J.job_step_progress(ev, J.WORKER_STEPS["classify_text"])


# ------------------------------------------------------------------ SRC / SNK

def q_read_csv_texts(spark, sf):
    path = IO.scratch_path(spark, "csv")
    docs = load(spark, sf, "documents").select("doc_id", "text")
    IO.write_csv(docs, f"{path}/good.csv")
    bad = spark.createDataFrame([("doc_id,text\nnot a number,x",)], "value string")  # a file with a malformed line
    bad.coalesce(1).write.option("lineSep", "\n").text(f"{path}/bad")
    schema = "doc_id long, text string, _corrupt_record string"
    back = IO.read_csv_texts(spark, f"{path}/good.csv", schema, multi_line=True).unionByName(
        IO.read_csv_texts(spark, f"{path}/bad", schema, glob=None))
    return back.select("doc_id", F.length("text").alias("n"), IO.text_hash("text").alias("h"), F.col("_corrupt_record").alias("corrupt"))


def q_read_request_texts(spark, sf):
    path = IO.scratch_path(spark, "requests")
    c = load(spark, sf, "conversations")
    # a request carries at most 100 texts (VAL3), so a long conversation becomes several requests
    # and no collected list is ever larger than 100 items
    chunk = F.floor(F.col("turn") / 100)
    req = c.groupBy("conv_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    req.select((F.col("conv_id") * 1000000 + F.col("chunk")).alias("request_id"), F.col("t.text").alias("texts")) \
        .write.mode("overwrite").json(path)
    back = IO.read_request_texts(spark, path)
    return back.select("request_id", "pos", IO.text_hash("text").alias("h"))


def q_select_csv_files(spark, sf):
    base = IO.scratch_path(spark, "mixed")
    docs = load(spark, sf, "documents").select("doc_id", "n_chars")
    IO.write_csv(docs, f"{base}/csv")
    docs.write.mode("overwrite").json(f"{base}/json")
    docs.write.mode("overwrite").parquet(f"{base}/parquet")
    reader = (spark.read.schema("doc_id long, n_chars long").option("header", True).option("recursiveFileLookup", True)
              .option("pathGlobFilter", "*.csv"))
    return reader.csv(base)


def q_assign_row_index(spark, sf):
    return IO.assign_row_index(load(spark, sf, "documents").select("doc_id"), ["doc_id"])


def _doc_results(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.col("lang").alias("prediction"), (1.0 / (1 + F.col("n_chars"))).alias("confidence"),
                    (F.col("doc_id") % 8).alias("bucket"), (F.floor(F.col("doc_id") / 8) % 3).alias("batch"))


def q_write_results(spark, sf):
    path = IO.scratch_path(spark, "results")
    res = _doc_results(spark, sf)
    half = res.withColumn("confidence", F.lit(0.0)).filter(F.col("doc_id") % 2 == 0)
    keys = ["bucket", "batch"]
    IO.write_results(half.filter("batch = 1"), path, keys)  # a batch whose task died half way
    for b in (0, 1, 2):  # batches of the same buckets: none replaces another, and the retry replaces its own
        IO.write_results(res.filter(F.col("batch") == b), path, keys)
    back = spark.read.parquet(path)
    return back.select("doc_id", "prediction", SC.round6("confidence").alias("confidence"), F.col("bucket").cast("long"))


def _report_source(spark, sf):
    r = TB.results(spark, sf)
    return r.select("job_id", "row_index", F.concat(F.lit("part "), F.col("l_quantity").cast("int").cast("string")).alias("text"),
                    "prediction", "confidence", F.lit("en").alias("language"), "processing_time", "error_message")


def q_export_csv_report(spark, sf):
    path = IO.scratch_path(spark, "report")
    IO.write_csv_report(_report_source(spark, sf), path, ["job_id", "row_index"])
    return IO.read_csv_report(spark, path)


def q_export_json(spark, sf):
    path = IO.scratch_path(spark, "json")
    res = TB.results(spark, sf).select("job_id", "row_index", "prediction", "confidence")
    IO.export_json(res, path)
    back = spark.read.schema("job_id long, row_index int, prediction string, confidence double").json(path)
    return back.select("job_id", "row_index", "prediction", SC.round6("confidence").alias("confidence"))


def q_save_user_results(spark, sf):
    """Two batches; the first attempt at the second dies between its files and its commit and is repeated."""
    h = TB.history(spark, sf).select("id", "user_id", "prediction")
    table = CommittedTable(spark, IO.scratch_path(spark, "saved"), h.schema)
    H.save_user_results(h.where("id % 2 = 0"), table, "job-1")

    def lost():
        raise RuntimeError("lost")

    odd = h.where("id % 2 = 1")
    with contextlib.suppress(RuntimeError):
        H.save_user_results(odd, table, "job-2", before_commit=lost)
    for _ in range(2):  # the retry, and one more that finds it done
        H.save_user_results(odd, table, "job-2")
    return table.read().select("id", "user_id")


QUERIES = {
    "assign_batches": q_assign_batches,
    "batch_progress": q_batch_progress,
    "job_status_live": q_job_status_live,
    "job_status_stored": q_job_status_stored,
    "job_results": q_job_results,
    "job_errors": q_job_errors,
    "job_transitions": q_job_transitions,
    "batch_summary": q_batch_summary,
    "per_row_time": q_per_row_time,
    "delete_job_cascade": q_delete_job_cascade,
    "queue_info": q_queue_info,
    "job_status_view": q_job_status_view,
    "batch_job_progress": q_batch_job_progress,
    "job_result_if_done": q_job_result_if_done,
    "clean_old_jobs": q_clean_old_jobs,
    "jobs_over_timeout": q_jobs_over_timeout,
    "job_step_progress": q_job_step_progress,
    "read_csv_texts": q_read_csv_texts,
    "read_request_texts": q_read_request_texts,
    "select_csv_files": q_select_csv_files,
    "assign_row_index": q_assign_row_index,
    "write_results": q_write_results,
    "export_csv_report": q_export_csv_report,
    "export_json": q_export_json,
    "save_user_results": q_save_user_results,
}

_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

ORACLES = {
    "assign_batches": (
        "SELECT doc_id, row_index, row_index // 16 + 1 AS batch, CAST(ceil(n / 16) AS BIGINT) AS total_batches FROM "
        "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index, count(*) OVER () AS n FROM documents) t"),
    "batch_progress": (
        f"WITH r AS {RESULTS_SQL}, b AS (SELECT job_id, row_index // 4 + 1 AS batch, CASE WHEN job_id % 5 = 0 AND "
        "row_index // 4 = 0 THEN 0 ELSE count(*) END AS c FROM r GROUP BY job_id, row_index // 4), "
        f"t AS (SELECT job_id, total_rows FROM {JOBS_SQL} j), "
        "p AS (SELECT job_id, batch, CAST(sum(c) OVER (PARTITION BY job_id ORDER BY batch) AS BIGINT) AS processed_rows FROM b) "
        "SELECT p.job_id, p.batch, p.processed_rows, t.total_rows, round(p.processed_rows * 100.0 / t.total_rows, 6) "
        "AS progress_pct FROM p JOIN t USING (job_id)"),
    "job_status_live": (
        f"WITH j AS {JOBS_SQL}, r AS {RESULTS_SQL}, a AS (SELECT job_id, "
        f"count(*) FILTER (WHERE created_at <= TIMESTAMP '{AS_OF_LIVE}') AS processed_rows FROM r GROUP BY job_id), "
        "x AS (SELECT j.job_id, j.status, j.started_at, j.batch_size, coalesce(a.processed_rows, 0) AS processed_rows, "
        "j.total_rows FROM j LEFT JOIN a USING (job_id)) "
        "SELECT job_id, status, processed_rows, total_rows, round(CASE WHEN total_rows = 0 THEN 0.0 ELSE "
        "processed_rows * 100.0 / total_rows END, 6) AS progress_pct, "
        f"{_ceil_div('processed_rows', 'batch_size')} AS current_batch, {_ceil_div('total_rows', 'batch_size')} AS total_batches, "
        f"round(CASE WHEN status = 'processing' AND processed_rows > 0 THEN (epoch(TIMESTAMP '{AS_OF_LIVE}') - "
        "epoch(started_at)) / processed_rows * (total_rows - processed_rows) END, 3) AS eta_seconds FROM x"),
    "job_status_stored": (
        f"SELECT job_id, status, processed_rows, total_rows, round(processed_rows * 100.0 / total_rows, 6) AS progress_pct, "
        f"{_ceil_div('processed_rows', 'batch_size')} AS current_batch, {_ceil_div('total_rows', 'batch_size')} AS total_batches, "
        f"NULL::DOUBLE AS eta_seconds FROM {JOBS_SQL} j"),
    "job_results": (
        f"SELECT j.job_id, j.status, r.row_index, r.prediction, round(r.confidence, 6) AS confidence "
        f"FROM {JOBS_SQL} j LEFT JOIN {RESULTS_SQL} r USING (job_id)"),
    "job_errors": (
        f"WITH r AS {RESULTS_SQL} SELECT job_id, row_index, 'Row ' || row_index || ': ' || error_message AS error FROM r "
        "WHERE error_message IS NOT NULL UNION ALL SELECT job_id, row_index, 'Row ' || row_index || "
        "': Batch processing failed - timeout' AS error FROM r WHERE l_linestatus = 'F' AND job_id % 50 = 0"),
    "job_transitions": (
        f"WITH a AS (SELECT job_id, max(created_at) AS last FROM {RESULTS_SQL} r GROUP BY job_id), "
        "x AS (SELECT j.job_id, j.status, j.started_at, CASE WHEN j.status <> 'processing' THEN coalesce(a.last, j.ended_at) END "
        f"AS completed_at FROM {JOBS_SQL} j LEFT JOIN a USING (job_id)) SELECT job_id, status AS final_status, completed_at, "
        "CASE WHEN status = 'completed' THEN CAST(epoch(completed_at) - epoch(started_at) AS BIGINT) END AS processing_time FROM x"),
    "batch_summary": (
        "SELECT conv_id, count(*) AS total_processed, count(*) FILTER (WHERE text IS NULL OR "
        f"length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) = 0 OR length(text) > 10000 OR role = 'system') "
        "AS failed, CAST(trunc(coalesce(max(turn + 1) FILTER (WHERE NOT (text IS NULL OR "
        f"length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) = 0 OR length(text) > 10000 OR role = 'system')), 0) * 100 "
        "/ count(*)) AS INTEGER) AS progress_pct FROM conversations GROUP BY conv_id"),
    "per_row_time": (
        f"WITH r AS (SELECT *, row_index // 16 + 1 AS batch FROM {RESULTS_SQL} r0) SELECT job_id, row_index, batch, "
        "round(sum(processing_time) OVER (PARTITION BY job_id, batch) / count(*) OVER (PARTITION BY job_id, batch), 6) "
        "AS per_row_time FROM r"),
    "delete_job_cascade": (
        f"SELECT job_id, row_index FROM {RESULTS_SQL} r WHERE job_id NOT IN "
        f"(SELECT job_id FROM {JOBS_SQL} j WHERE status = 'failed')"),
    "queue_info": (
        f"WITH q AS {_values([(x,) for x in QUEUE_NAMES], ['queue'])}, j AS {QJOBS_SQL} SELECT q.queue, "
        + ", ".join(f"count(j.job_id) FILTER (WHERE j.status = '{s}') AS {'length' if s == 'queued' else s}"
                    for s in J.QUEUE_STATUSES)
        + " FROM q LEFT JOIN j ON j.queue = q.queue GROUP BY q.queue"),
    "job_status_view": (
        "WITH req AS (SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 100 = 0 UNION ALL "
        f"SELECT -1 - o_orderkey FROM orders WHERE o_orderkey % 100 = 0), j AS {QJOBS_SQL} "
        "SELECT req.job_id, coalesce(j.status, 'not_found') AS status, CASE WHEN j.status = 'finished' THEN j.result END "
        "AS result, CASE WHEN j.status = 'failed' THEN j.failure_info END AS failure_info, "
        "CASE WHEN j.job_id IS NULL THEN 'Job not found' WHEN j.status = 'failed' THEN coalesce(j.failure_info, 'Unknown error') "
        "END AS error, CASE j.status WHEN 'finished' THEN 'completed ' || j.total || ' ' || j.total || ' 100' WHEN 'started' THEN "
        "'processing ' || (j.total // 3) || ' ' || j.total || ' ' || CAST(trunc((j.total // 3) * 100.0 / j.total) AS INTEGER) WHEN 'failed' THEN "
        "'failed ' || (j.total // 2) || ' ' || j.total || ' ' || CAST(trunc((j.total // 2) * 100.0 / j.total) AS INTEGER) ELSE '' END AS noted, "
        "j.queue AS queue_name, strftime(j.started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, "
        "strftime(j.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(j.ended_at, '%Y-%m-%dT%H:%M:%S') AS ended_at "
        "FROM req LEFT JOIN j USING (job_id)"),
    "job_result_if_done": f"SELECT job_id, CASE WHEN status = 'finished' THEN result END AS result FROM {QJOBS_SQL} j",
    "clean_old_jobs": (
        f"WITH q AS {_values([(x,) for x in QUEUE_NAMES], ['queue'])}, j AS {QJOBS_SQL} SELECT q.queue, "
        f"count(j.job_id) AS cleaned FROM q LEFT JOIN j ON j.queue = q.queue AND j.status = 'finished' AND "
        f"j.ended_at < TIMESTAMP '{AS_OF_CLEAN}' - INTERVAL 7 DAY GROUP BY q.queue"),
    "jobs_over_timeout": (
        f"WITH l AS {_values([(q, J.QUEUE_TIMEOUTS[k]) for q, k in QUEUE_KIND.items()], ['queue', 'limit_seconds'])} "
        "SELECT j.job_id, j.queue, CAST(epoch(j.ended_at) - epoch(j.started_at) AS BIGINT) AS run_seconds, "
        f"CAST(l.limit_seconds AS INTEGER) AS limit_seconds FROM {QJOBS_SQL} j JOIN l USING (queue) "
        "WHERE epoch(j.ended_at) - epoch(j.started_at) > l.limit_seconds"),
    "job_step_progress": (
        "WITH e AS (SELECT user_id AS job, event_id % 3 + 1 AS step, ts FROM events), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, step DESC) AS rk, "
        "count(*) OVER (PARTITION BY job) AS events FROM e) SELECT job, step, 3 AS total_steps, "
        f"{list(J.WORKER_STEPS['classify_text'])}[step] AS status, events FROM r WHERE rk = 1"),
    "read_csv_texts": (
        "SELECT doc_id, length(text) AS n, sha256(text) AS h, NULL::VARCHAR AS corrupt FROM documents "
        "UNION ALL SELECT NULL, 1, sha256('x'), 'not a number,x'"),
    "batch_job_progress": (
        f"WITH r AS {RESULTS_SQL}, a AS (SELECT job_id, count(*) AS n, count(error_message) AS bad, "
        "max(pos) FILTER (WHERE error_message IS NULL) AS last FROM (SELECT *, row_number() OVER (PARTITION BY job_id "
        "ORDER BY created_at, l_linenumber * 2 + CASE WHEN error_message IS NULL THEN 0 ELSE 1 END) AS pos FROM r) p GROUP BY job_id), "
        "x AS (SELECT j.job_id, CASE j.status WHEN 'processing' THEN 'processing' ELSE j.status END AS state, coalesce(a.n, 0) AS n, "
        f"coalesce(a.n, 0) + j.job_id % 2 AS total, coalesce(a.bad, 0) AS failed, coalesce(a.last, 0) AS last FROM {JOBS_SQL} j LEFT JOIN a USING (job_id)) "
        "SELECT job_id, state, CASE WHEN state = 'completed' THEN total ELSE last END AS processed, total, "
        "CAST(CASE WHEN state = 'completed' THEN 100 WHEN total = 0 THEN 0 ELSE trunc(last * 100.0 / total) END AS INTEGER) AS percentage, failed, "
        "CAST(CASE WHEN state <> 'processing' AND job_id % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN job_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rejected FROM x"),
    "read_request_texts": (
        "SELECT conv_id * 1000000 + turn // 100 AS request_id, CAST(row_number() OVER (PARTITION BY conv_id, turn // 100 "
        "ORDER BY turn) - 1 AS INTEGER) AS pos, sha256(text) AS h FROM conversations"),
    "select_csv_files": "SELECT doc_id, n_chars FROM documents",
    "assign_row_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents",
    "write_results": (
        "SELECT doc_id, lang AS prediction, round(1.0 / (1 + n_chars), 6) AS confidence, doc_id % 8 AS bucket FROM documents"),
    "export_csv_report": (
        f"SELECT CAST(row_index AS VARCHAR) AS \"Row Index\", 'part ' || CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) "
        "AS \"Text\", prediction AS \"Prediction\", printf('%.2f%%', confidence * 100) AS \"Confidence\", 'en' AS \"Language\", "
        "printf('%.0f', processing_time * 1000) AS \"Processing Time (ms)\", coalesce(error_message, '') AS \"Error\" "
        f"FROM {RESULTS_SQL} r"),
    "export_json": f"SELECT job_id, CAST(row_index AS INTEGER) AS row_index, prediction, round(confidence, 6) AS confidence FROM {RESULTS_SQL} r",
    "save_user_results": f"SELECT id, user_id FROM {HIST_SQL} h WHERE user_id IS NOT NULL",
}
