"""Jobs, history, reports and streams on inputs that a plan could get wrong: hot jobs, repeated requests, lost writers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verba.operators import history as H
from verba.operators import jobs as J
from verba.operators import registry as G
from verba.operators import report as R
from verba.sources import io as IO
from verba.sources.commits import CommittedTable
from verba.streaming import streams as ST

T0 = dt.datetime(2020, 1, 1)


def test_batch_progress_of_a_hot_job_spans_tasks(spark):
    n = 3000
    batches = spark.range(1, n + 1).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("job_id"),
                                           F.col("id").alias("batch"), (F.col("id") % 5).alias("in_batch"))
    jobs = batches.select("job_id").distinct().withColumn("total_rows", F.lit(10_000).cast("long"))
    got = sorted((r.batch, r.processed_rows) for r in J.batch_progress(jobs, batches).collect() if r.job_id == 1)
    total, want = 0, []
    for k in range(3, n + 1, 3):
        total += k % 5
        want.append((k, total))
    assert got == want
    from verba.operators.scan import running
    plan = running(batches, ["job_id"], ["batch"], {"x": ("sum", F.col("in_batch"))})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(job_id" not in plan  # nothing is dealt by job alone


def plain_fold(events):
    state, texts, last, failed, rejected, total = "new", 0, 0, 0, 0, None
    for e, n in events:
        to = J.MOVES.get((state, e))
        if to is None:
            rejected += 1
            continue
        state = to
        if e in ("ok", "failed_text"):
            texts += 1
            last = texts if e == "ok" else last
            failed += e == "failed_text"
        if e == "start":
            total = n
    processed = (total if total is not None else texts) if state == "completed" else last
    pct = 100 if state == "completed" else int(last * 100 / total) if total else 0
    return state, processed, total, pct, failed, rejected


def test_fold_of_random_logs(spark):
    rng, rows, want = random.Random(8), [], {}
    for job in range(60):
        events = []
        n = rng.choice([0, 1, 3, 40]) if job else 1500  # job 0 has most events
        for _ in range(n + 1):
            events.append((rng.choice(["start", "ok", "ok", "ok", "failed_text", "what"] + ["complete", "fail"] * (rng.random() < 0.1)), rng.randint(0, 60)))
        if rng.random() < 0.7:
            events.insert(0, ("start", rng.randint(0, 60)))
        want[job] = plain_fold(events)
        rows += [(job, T0 + dt.timedelta(seconds=k // 2), k, e, t if e == "start" else None) for k, (e, t) in enumerate(events)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "job_id long, ts timestamp, seq int, event string, total long").repartition(4)
    got = {r.job_id: tuple(r)[1:] for r in J.fold_job_events(log).collect()}
    assert got == want
    assert J.fold_job_events(log.limit(0)).count() == 0


def test_requests_that_repeat_delete_once(spark):
    h = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None)], "id long, user_id long")
    rows = [(100, 1, 10), (101, 1, 10), (100, 2, 10), (102, 3, 10), (103, 9, 10), (104, 4, None), (105, 3, 11), (105, 3, 11)]
    kept, outcome = H.delete_history_items(h, spark.createDataFrame(rows, "request_id long, item_id long, requester long"))
    assert sorted(r.id for r in kept.collect()) == [4]
    got = sorted((r.request_id, r.outcome == "deleted") for r in outcome.collect())
    assert got == [(100, True), (100, True), (101, False), (102, False), (103, False), (104, False), (105, False), (105, True)]
    users = spark.createDataFrame([(10,), (10,), (77,)], "user_id long")
    kept, per_user = H.delete_all_history(h, users)
    assert {r.user_id: r.deleted_count for r in per_user.collect()} == {10: 2, 77: 0} and per_user.count() == 2
    assert kept.count() == 2


def test_selection_summary_of_unknown_keys_and_tasks(spark):
    sel = spark.createDataFrame([(1, "spam", "who"), (2, "weather", "roberta-sms"), (3, "weather", None)], "request_id long, task string, model_key string")
    got = {r.request_id: r.summary for r in R.selection_summary(sel, G.registry_df(spark)).collect()}
    assert got == {1: "Single model: who", 2: "Single model: roberta-sms", 3: "No model selected (will use all models)"}


def test_selection_rules_agree(spark):
    asked = [(0, "spam", "all", None), (1, "spam", None, None), (2, "spam", "roberta-sms", None), (3, "spam", "nope", None), (4, "spam", "nope,roberta-sms", None),
             (5, "spam", "a,b", None), (6, "spam", None, ["distilbert-sms", "x"]), (7, "spam", None, []), (8, "topic", "all", None)]
    req = spark.createDataFrame(asked, "conv_id long, task string, sel_str string, sel_list array<string>")
    rows = G.resolve_model_selection(req, G.registry_df(spark)).collect()
    for i, task, text, keys in asked:
        mine = sorted((r.pos, r.model_key) for r in rows if r.conv_id == i and r.error is None)
        errors = [r.error for r in rows if r.conv_id == i and r.error]
        try:
            want = G.resolve_selection(task, keys if keys is not None else text)
            assert [k for _, k in mine] == want and not errors, i
        except ValueError as e:
            assert errors == [str(e)] and not mine, i


def rows_read(df):
    """Rows that the scans of an executed plan produced."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if name == "FileSourceScanExec":
            total += int(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return total


def test_pages_and_lookups_read_few_row_groups(spark):
    n, users = 400_000, 20
    h = spark.range(n).select(F.xxhash64("id").alias("id"), (F.col("id") % users).alias("user_id"), F.col("id").alias("k"),
                              F.timestamp_seconds(F.lit(1_500_000_000) + F.col("id") % 100_000).alias("created_at"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    path = IO.scratch_path(spark, "clustered")
    H.write_clustered(h, path, row_group_bytes=1 << 20)
    back = spark.read.parquet(path)
    mine = sorted(((r.created_at, r.id) for r in h.where("user_id = 7").select("created_at", "id").collect()), reverse=True)
    for page in (1, 2, 1000):
        after = mine[(page - 1) * 10 - 1] if page > 1 else None
        cut = H.history_after(back.select("user_id", "created_at", "id"), 7, after, 10)
        assert [(r.created_at, r.id) for r in cut.collect()] == mine[(page - 1) * 10: page * 10]
        assert rows_read(cut) < n / 10
    one = spark.createDataFrame([(mine[5][1],)], "id long").first().id
    point = back.where(F.col("id") == one).select("id", "text")
    assert point.count() == 1 and rows_read(point) < n / 4


def test_report_is_one_csv(spark):
    rows = [(1, k, f'say "{k}"\nnow, please' if k % 7 == 0 else f"text {k}", "spam", k / 997, "en", k / 1000, "model failed" if k % 50 == 1 else None)
            for k in range(300)] + [(2, 0, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "job_id int, row_index int, text string, prediction string, confidence double, language string, "
                                     "processing_time double, error_message string").repartition(5)
    path = IO.scratch_path(spark, "report")
    IO.write_csv_report(df, path, ["job_id", "row_index"])
    files = sorted((r.path, r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content").collect())
    got = b"".join(bytes(c) for _, c in files).decode()
    lines = ["Row Index,Text,Prediction,Confidence,Language,Processing Time (ms),Error"]
    for _, k, text, pred, conf, lang, t, err in rows:
        quoted = '"' + (text or "").replace('"', '""') + '"'
        lines.append(",".join([str(k), quoted, pred or "", f"{conf * 100:.2f}%" if conf is not None else "", lang or "", f"{t * 1000:.0f}" if t is not None else "", err or ""]))
    assert got.count("Row Index") == 1 and len(files) > 1
    bad = [(a, b) for a, b in zip(got.rstrip("\n").split("\n"), "\n".join(lines).split("\n"), strict=True) if a != b]
    assert not bad, bad[:3]
    assert IO.read_csv_report(spark, path).count() == 301
    empty = IO.scratch_path(spark, "report")
    IO.write_csv_report(df.limit(0), empty, ["job_id", "row_index"])
    assert IO.read_csv_report(spark, empty).count() == 0 and spark.read.text(empty).first().value == lines[0]


def test_saved_results_survive_a_lost_writer(spark):
    table = CommittedTable(spark, IO.scratch_path(spark, "saved"), "id long, user_id long")
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, user_id long")

    def lost():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        H.save_user_results(df, table, "job-1", before_commit=lost)
    assert table.read().count() == 0
    assert H.save_user_results(df, table, "job-1") and not H.save_user_results(df, table, "job-1")
    assert [tuple(r) for r in table.read().collect()] == [(1, 5)]


def test_job_state_ends_with_its_job(spark):
    """Jobs of three rows, one after the other: at the end only the last ones are held. One job is silent, one is hot."""
    rows = []
    for job in range(40):
        rows += [(job, None if k else "bad", T0 + dt.timedelta(days=10 * job, seconds=k)) for k in range(3 if job != 5 else 2)]
    rows += [(100, None, T0 + dt.timedelta(hours=k)) for k in range(200)]
    results = spark.createDataFrame(rows, "job_id long, error_message string, created_at timestamp").repartition(3)
    totals = spark.createDataFrame([(j, 3) for j in range(40)] + [(100, 1000)], "job_id long, total_rows long")
    held, run = [], ST.run_available

    def spied(*a, **k):
        q = run(*a, **k)
        ops = [o for p in q.recentProgress for o in p.stateOperators]
        held.append(max((o.numRowsTotal for o in ops[-1:]), default=0))
        return q

    ST.run_available = spied
    try:
        got = {r.job_id: r for r in ST.stream_job_progress(spark, results, totals, deliveries=8, silence="30 days", delay="1 hour").collect()}
    finally:
        ST.run_available = run
    assert len(got) == 41
    assert all((got[j].processed_rows, got[j].failed_rows, got[j].state) == (3, 1, "completed") for j in range(40) if j != 5)
    assert (got[5].processed_rows, got[5].state) == (2, "silent")
    assert got[100].state == "silent" and got[100].processed_rows == 200
    assert held[-1] <= 12, held  # counts and timers of the last few jobs, not of 41
