"""Batch jobs, progress and queue tables as relational Spark plans.

Skew: a single job may own a third of all result rows. Per-job figures are
combinable aggregates (count/sum/max with map-side partial aggregation), running
figures are segmented prefix sums over range partitions (``scan.py``), and the fold
of a job's events is composed from parts of it; windows appear only over groups
bounded by the batch size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verba.operators.scan import running
from verba.session import materialize, partitions

# ---- fixed values ----
ALLOWED_BATCH_SIZES = (1, 4, 8, 16, 64, 128, 256)
DEFAULT_BATCH_SIZE = 16
JOB_STATUSES = ("processing", "completed", "failed")
QUEUE_STATUSES = ("queued", "failed", "scheduled", "started", "finished")
# The reference's per-queue time limits in seconds (classification / CSV / batch).
QUEUE_TIMEOUTS = {"classification": 300, "csv_processing": 1800, "batch_processing": 600}
WORKER_STEPS = {
    "classify_text": ["detecting_language", "classifying", "saving_result"],
    "process_csv": ["parsing_csv", "processing_texts", "getting_results"],
}
TOTAL_STEPS = 3
UNKNOWN_ERROR = "Unknown error"
NOT_FOUND = "not_found"
JOB_NOT_FOUND = "Job not found"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ceil_div(a, b) -> Column:
    return F.when(_c(b) > 0, ((_c(a) + _c(b) - 1) / _c(b)).cast("long")).otherwise(F.lit(0).cast("long"))


def assign_batches(df: DataFrame, row_index: str = "row_index", size: int = DEFAULT_BATCH_SIZE,
                   total_rows: Column | None = None) -> DataFrame:
    """BAT1: batch = row_index // size + 1; total_batches = ceil(n / size) (n given as a column)."""
    out = df.withColumn("batch", (F.floor(F.col(row_index) / size) + 1).cast("long"))
    if total_rows is not None:
        out = out.withColumn("total_batches", ceil_div(total_rows, F.lit(size)))
    return out


def batch_progress(jobs: DataFrame, batches: DataFrame) -> DataFrame:
    """BAT2: after each batch, rows processed so far and 100 * processed / the job's total_rows.
    ``batches``: (job_id, batch, in_batch), a row per batch with the rows it wrote; a failed batch wrote
    none and moves the count by nothing. The running sum is over batches, not rows, and segmented: a job
    with a third of all batches spans its share of the tasks."""
    run = running(batches.select("job_id", "batch", "in_batch"), ["job_id"], ["batch"], {"processed_rows": ("sum", F.col("in_batch"))})
    return run.join(jobs.select("job_id", "total_rows"), "job_id").select(
        "job_id", "batch", "processed_rows", "total_rows",
        F.coalesce(F.try_divide(F.col("processed_rows") * 100.0, F.col("total_rows")), F.lit(0.0)).alias("progress_pct"))


def batch_counts(results: DataFrame, size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Rows written per batch."""
    return assign_batches(results, size=size).groupBy("job_id", "batch").agg(F.count(F.lit(1)).alias("in_batch"))


def job_status_live(jobs: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """BAT3: status, progress, current/total batch and ETA = elapsed / processed * remaining, null unless
    processing and processed > 0. Total rows and batch size are the job's own. ``as_of`` is the clock."""
    now = F.lit(as_of).cast("timestamp")
    agg = results.where(F.col("created_at") <= now).groupBy("job_id").agg(F.count(F.lit(1)).alias("processed_rows"))
    j = jobs.select("job_id", "status", "started_at", "total_rows", "batch_size").join(agg, "job_id", "left") \
        .fillna(0, subset=["processed_rows"])
    elapsed = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    eta = F.when((F.col("status") == "processing") & (F.col("processed_rows") > 0),
                 F.try_divide(elapsed.cast("double"), F.col("processed_rows")) * (F.col("total_rows") - F.col("processed_rows")))
    return j.select(
        "job_id", "status", "processed_rows", "total_rows",
        F.coalesce(F.try_divide(F.col("processed_rows") * 100.0, F.col("total_rows")), F.lit(0.0)).alias("progress_pct"),
        ceil_div("processed_rows", "batch_size").alias("current_batch"),
        ceil_div("total_rows", "batch_size").alias("total_batches"),
        eta.alias("eta_seconds"),
    )


def job_status_stored(jobs: DataFrame, size_col: str = "batch_size") -> DataFrame:
    """BAT4: from the stored row only; ETA is null."""
    return jobs.select(
        "job_id", "status", "processed_rows", "total_rows", "progress_pct",
        ceil_div("processed_rows", size_col).alias("current_batch"),
        ceil_div("total_rows", size_col).alias("total_batches"),
        F.lit(None).cast("double").alias("eta_seconds"),
    )


def job_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """BAT5 flat form: job header beside each of its result rows (jobs without results kept). An inner
    join, whose result side may be split where one job has very many rows, and the jobs without any."""
    j = jobs.select("job_id", "status")
    bare = j.join(results.select("job_id").distinct(), "job_id", "left_anti")
    return j.join(results, "job_id").unionByName(bare, allowMissingColumns=True)


def job_errors(results: DataFrame, failed_batch: Column, batch_msg: Column) -> DataFrame:
    """BAT6: 'Row {idx}: {msg}' per failed row, plus 'Row {idx}: Batch processing failed - {msg}'
    for every row of a failed batch."""
    rows = results.filter(F.col("error_message").isNotNull()).select(
        "job_id", "row_index", F.format_string("Row %d: %s", "row_index", "error_message").alias("error"))
    batches = results.filter(failed_batch).select(
        "job_id", "row_index", F.format_string("Row %d: Batch processing failed - %s", F.col("row_index"), batch_msg).alias("error"))
    return rows.unionByName(batches)


def job_transitions(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """BAT7: processing -> completed, or -> failed where the whole run failed; errors of rows or batches
    leave a job completed. completed_at = the last result, else the job's own end; a completed job has a
    processing_time = completed_at - started_at in seconds. Jobs without results stay."""
    agg = results.groupBy("job_id").agg(F.max("created_at").alias("last_result"))
    j = jobs.select("job_id", "status", "started_at", "ended_at").join(agg, "job_id", "left")
    done = F.when(F.col("status") != "processing", F.coalesce("last_result", "ended_at"))
    return j.withColumn("completed_at", done).select(
        "job_id", F.col("status").alias("final_status"), "completed_at",
        F.when(F.col("status") == "completed", F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))
        .alias("processing_time"))


def batch_summary(texts: DataFrame, request: str, failed: Column, position: Column) -> DataFrame:
    """BAT8: total_processed counts failures too; progress_pct, truncated to int, moves with each text
    that succeeds, to its position (from 1) among all."""
    g = texts.groupBy(request).agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count(F.when(failed, F.lit(1))).alias("failed"),
        F.max(F.when(~failed, position)).alias("last"),
    )
    pct = (F.coalesce("last", F.lit(0)) * 100 / F.col("total_processed")).cast("int")
    return g.select(request, "total_processed", "failed", pct.alias("progress_pct"))


def per_row_time(results: DataFrame, size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """BAT9: a row's time = its batch's elapsed time / rows in the batch. The window is
    bounded by the batch size, so a hot job cannot put an unbounded group in one task."""
    b = assign_batches(results, size=size)
    w = Window.partitionBy("job_id", "batch")
    return b.select("job_id", "row_index", "batch",
                    (F.sum("processing_time").over(w) / F.count(F.lit(1)).over(w)).alias("per_row_time"))


def delete_job_cascade(jobs: DataFrame, results: DataFrame, doomed: DataFrame):
    """BAT10: deleting jobs removes their results. Returns (jobs kept, results kept)."""
    keys = doomed.select("job_id").distinct()
    return jobs.join(keys, "job_id", "left_anti"), results.join(keys, "job_id", "left_anti")


# ------------------------------------------------------------------ queue tables

def queue_info(queue_jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """QUE1: per queue, counts by status; queues without jobs are kept with zeros."""
    p = queue_jobs.groupBy("queue").agg(*[F.count_if(F.col("status") == s).alias(s) for s in QUEUE_STATUSES])
    out = queues.join(p, "queue", "left")
    cols = [F.coalesce(F.col(s), F.lit(0)).cast("long").alias("length" if s == "queued" else s) for s in QUEUE_STATUSES]
    return out.select("queue", *cols)


def job_status_view(requested: DataFrame, queue_jobs: DataFrame) -> DataFrame:
    """QUE2: result only if finished; failure_info only if failed and known, error then says it or
    'Unknown error'; an unknown id is not_found with the error 'Job not found'. ``progress`` is the job's
    own, a struct of status, processed, total and percentage, null if none was ever noted."""
    j = requested.join(queue_jobs, "job_id", "left")
    found = F.col("status").isNotNull()
    return j.select(
        "job_id",
        F.when(found, F.col("status")).otherwise(F.lit(NOT_FOUND)).alias("status"),
        F.when(F.col("status") == "finished", F.col("result")).alias("result"),
        F.when(F.col("status") == "failed", F.col("failure_info")).alias("failure_info"),
        F.when(~found, F.lit(JOB_NOT_FOUND)).when(F.col("status") == "failed", F.coalesce(F.col("failure_info"), F.lit(UNKNOWN_ERROR)))
        .alias("error"),
        "progress",
        F.col("queue").alias("queue_name"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"),
        F.date_format("ended_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ended_at"),
    )


def job_result_if_done(queue_jobs: DataFrame) -> DataFrame:
    """QUE3"""
    return queue_jobs.select("job_id", F.when(F.col("status") == "finished", F.col("result")).alias("result"))


def clean_old_jobs(queue_jobs: DataFrame, queues: DataFrame, as_of, days: int = 7):
    """QUE4: drop finished jobs that ended before as_of - days (1..30). Returns (per-queue
    counts with zeros, surviving jobs). The survivor filter is the null-safe negation."""
    if not 1 <= days <= 30:
        raise ValueError("days must be in 1..30")
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    old = (F.col("status") == "finished") & (F.col("ended_at") < cutoff)
    counts = queue_jobs.filter(old).groupBy("queue").agg(F.count(F.lit(1)).alias("cleaned"))
    per_queue = queues.join(counts, "queue", "left").select("queue", F.coalesce("cleaned", F.lit(0)).cast("long").alias("cleaned"))
    survivors = queue_jobs.filter(~F.coalesce(old, F.lit(False)))
    return per_queue, survivors


def jobs_over_timeout(queue_jobs: DataFrame, limits: DataFrame) -> DataFrame:
    """QUE5: run time beyond the queue's limit (limits: a few rows, broadcast)."""
    run = F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")
    j = queue_jobs.join(F.broadcast(limits), "queue")
    return j.filter(run > F.col("limit_seconds")).select("job_id", "queue", run.alias("run_seconds"), "limit_seconds")


def job_step_progress(progress_log: DataFrame, steps: list) -> DataFrame:
    """QUE6: latest step per job (max_by on time, combinable), with the step's status name."""
    g = progress_log.groupBy("job").agg(
        F.max_by(F.struct("step", "ts"), F.struct("ts", "step")).alias("last"),
        F.count(F.lit(1)).alias("events"),
    )
    names = F.array(*[F.lit(s) for s in steps])
    return g.select(
        "job", F.col("last.step").alias("step"), F.lit(TOTAL_STEPS).alias("total_steps"),
        F.element_at(names, F.col("last.step").cast("int")).alias("status"),
        "events",
    )


# ------------------------------------------------------------------ a job's life as a fold of its events

STATES = ("new", "processing", "completed", "failed")
EVENTS = ("start", "ok", "failed_text", "complete", "fail")
# (state, event) -> state; what is missing is impossible and rejected.
MOVES = {("new", "start"): "processing", ("processing", "ok"): "processing", ("processing", "failed_text"): "processing",
         ("processing", "complete"): "completed", ("processing", "fail"): "failed"}


FIGURES = ("texts", "last", "failed", "rejected", "total")


def _part(state, texts, last, failed, rejected, total) -> Column:
    n = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(n(state).cast("int").alias("state"), *[n(c).cast("long").alias(k) for k, c in zip(
        FIGURES, (texts, last, failed, rejected, total), strict=True)])


def _folder():
    """What folds sorted events in a task: batches of (job_id, e, total, _p) -> batches of (job_id, _p, s, state, FIGURES),
    a row for each job and each state s that the job may be in before its events here. _p is null where a job has
    no events in other partitions: then s is "new" alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    k, kinds = len(STATES), len(EVENTS) + 1
    table = np.array([[STATES.index(MOVES[s, e]) if (s, e) in MOVES else -1 for e in (*EVENTS, None)] for s in STATES])
    # a map of states is a number in base k, its digits the states that states 0, 1, ... go to
    digits = np.arange(k ** k)[:, None] // k ** np.arange(k) % k
    after = np.zeros((k ** k, k ** k), dtype=np.uint16)  # [second, first]
    for s in range(k):
        after += (digits[:, digits[:, s]] * k ** s).astype(np.uint16)
    moves = (np.where(table >= 0, table, np.arange(k)[:, None]) * (k ** np.arange(k))[:, None]).sum(0).astype(np.uint16)

    def figures(at, e, total, known):
        """Events e with their totals (known where there is one), jobs beginning at ``at`` -> arrays [s, job] by name."""
        n = len(e)
        job = np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))
        place = np.arange(n) - at[job]
        so_far, step = moves[e], 1  # the map of all events of a job up to each, by doubling
        while step <= place.max():
            so_far = np.concatenate([so_far[:step], np.where(place[step:] >= step, after[so_far[step:], so_far[:-step]], so_far[step:])])
            step *= 2
        ends = np.append(at[1:], n) - 1
        out = {name: np.zeros((k, len(at)), dtype=np.int64) for name in ("state", *FIGURES)}
        out["known"] = np.zeros((k, len(at)), dtype=bool)
        for s in range(k):
            state = np.full(n, s)
            state[1:] = np.where(place[1:] > 0, digits[so_far[:-1], s], s)
            legal = table[state, e] >= 0
            text = legal & ((e == 1) | (e == 2))
            texts = np.cumsum(text)
            texts -= (texts[at] - text[at])[job]
            out["state"][s] = digits[so_far[ends], s]
            out["texts"][s] = texts[ends]
            out["last"][s] = np.maximum.reduceat(np.where(legal & (e == 1), texts, 0), at)
            out["failed"][s] = np.add.reduceat((legal & (e == 2)).astype(np.int64), at)
            out["rejected"][s] = np.add.reduceat((~legal).astype(np.int64), at)
            start = np.maximum.reduceat(np.where(legal & (e == 0), np.arange(n), -1), at)  # the last legal start
            out["known"][s] = (start >= 0) & known[start]
            out["total"][s] = np.where(out["known"][s], total[start], 0)
        return out

    def then(a, b):
        """Figures [s, 1] of a job's events, and of those after them -> of all of them."""
        b = {name: v[a["state"][:, 0]] for name, v in b.items()}
        out = {name: a[name] + b[name] for name in ("texts", "failed", "rejected")}
        out["last"] = np.where(b["last"] > 0, a["texts"] + b["last"], a["last"])
        out["total"], out["known"] = np.where(b["known"], b["total"], a["total"]), a["known"] | b["known"]
        return out | {"state": b["state"]}

    def same(a, b):
        """Which ids of a equal those of b; nulls are equal."""
        null = pc.and_(pc.is_null(a), pc.is_null(b))
        return np.asarray(pc.or_(null, pc.fill_null(pc.equal(a, b), False)))

    def rows(ids, p, got, edges):
        n = len(ids)
        s = np.concatenate([np.zeros(n, dtype=np.int64)] + [np.full(int(edges.sum()), i) for i in range(1, k)])
        j = np.concatenate([np.arange(n)] + [np.flatnonzero(edges)] * (k - 1))
        cols = {name: got[name][s, j] for name in ("state", *FIGURES)}
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(j)), pa.array(np.full(len(j), p, dtype=np.int32), mask=~edges[j]), pa.array(s.astype(np.int32)),
             pa.array(cols["state"].astype(np.int32)), *[pa.array(cols[name]) for name in FIGURES[:-1]],
             pa.array(cols["total"], mask=~got["known"][s, j])], names=["job_id", "_p", "s", "state", *FIGURES])

    def fold(batches):
        held, p, first = None, 0, True  # the job that the batch before ended with: its id and figures
        for b in batches:
            if not b.num_rows:
                continue
            ids, p = b.column("job_id"), b.column("_p")[0].as_py()
            begins = np.ones(len(ids), dtype=bool)
            begins[1:] = ~same(ids.slice(1), ids.slice(0, len(ids) - 1))
            at = np.flatnonzero(begins)
            total = b.column("total")
            got = figures(at, np.asarray(b.column("e")), np.asarray(pc.fill_null(total, 0)), ~np.asarray(pc.is_null(total)))
            ids = ids.take(pa.array(at))
            if held is not None:
                if same(held[0], ids.slice(0, 1))[0]:
                    whole = then(held[1], {name: v[:, :1] for name, v in got.items()})
                    got = {name: np.concatenate([whole[name], v[:, 1:]], axis=1) for name, v in got.items()}
                else:
                    ids = pa.concat_arrays([held[0], ids])
                    got = {name: np.concatenate([held[1][name], v], axis=1) for name, v in got.items()}
            n = len(ids) - 1
            held = ids.slice(n), {name: v[:, n:] for name, v in got.items()}
            if n:
                edges = np.zeros(n, dtype=bool)
                edges[0], first = first, False
                yield rows(ids.slice(0, n), p, {name: v[:, :n] for name, v in got.items()}, edges)
        if held is not None:
            yield rows(held[0], p, held[1], np.ones(1, dtype=bool))

    return fold


def fold_job_events(log: DataFrame) -> DataFrame:
    """QUE6, BAT7, BAT8: the state of each job after its events. log: (job_id, ts, seq, event, total), total with
    the start; events of a job are read by (ts, seq).

    Impossible events (a text before the start or after the end, a second end) change nothing and are
    counted as ``rejected``; unknown ones are. ``processed`` is the position of the last text that
    succeeded, among all texts, and all of them once the job is completed; ``percentage`` is truncated.

    An event is a function on states, and functions compose: each range partition folds its part of a
    job for every state that the job may be in when the part begins, and the parts of a job, a row per
    partition, are composed in order. So a job with a third of all events is folded by many tasks. Only the first
    and the last job of a partition can have parts elsewhere; the others are done where they lie."""
    code = F.coalesce(*[F.when(F.col("event") == e, F.lit(k)) for k, e in enumerate(EVENTS)], F.lit(len(EVENTS)))
    # written, since the bounds of the ranges are found by a pass of its own, which would make the log anew
    events = materialize(log.select("job_id", "ts", "seq", code.alias("e"), F.col("total").cast("long")))
    order = ["job_id", "ts", "seq"]
    dealt = events.repartitionByRange(partitions(events), *order).sortWithinPartitions(*order, "e", "total")
    # ... and the parts, which must come from the same bounds
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    parts = materialize(dealt.select("job_id", "e", "total", F.spark_partition_id().alias("_p")).mapInArrow(
        lambda batches: _folder()(batches),
        f"job_id {types['job_id']}, _p int, s int, state int, " + ", ".join(f"{c} long" for c in FIGURES)))

    def then(a, part):
        b = part["f"][a["state"]]
        return _part(b["state"], a["texts"] + b["texts"], F.when(b["last"] > 0, a["texts"] + b["last"]).otherwise(a["last"]),
                     a["failed"] + b["failed"], a["rejected"] + b["rejected"], F.coalesce(b["total"], a["total"]))

    figures = F.struct("state", *FIGURES)
    of = parts.where("_p IS NOT NULL").groupBy("job_id", "_p").agg(F.sort_array(F.collect_list(F.struct("s", figures.alias("f")))).alias("x"))
    of = of.select("job_id", "_p", F.transform("x", lambda x: x["f"]).alias("f"))  # two rows per partition at most
    spread = of.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("_p", "f"))).alias("x"))
    spread = spread.select("job_id", F.aggregate("x", _part(0, 0, 0, 0, 0, F.lit(None).cast("long")), then).alias("s"))
    out = parts.where("_p IS NULL").select("job_id", figures.alias("s")).unionByName(spread)
    done = F.col("s.state") == STATES.index("completed")
    processed = F.when(done, F.coalesce("s.total", "s.texts")).otherwise(F.col("s.last"))
    pct = F.when(done, F.lit(100)).otherwise(F.coalesce(F.try_divide(processed * 100, F.col("s.total")), F.lit(0.0)).cast("int"))
    return out.select("job_id", F.element_at(F.array(*map(F.lit, STATES)), F.col("s.state") + 1).alias("state"), processed.alias("processed"),
                      F.col("s.total").alias("total"), pct.alias("percentage"), F.col("s.failed").alias("failed"), F.col("s.rejected").alias("rejected"))
