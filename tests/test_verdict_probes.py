"""Inputs on which earlier versions were wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verba.operators import history as H
from verba.operators import jobs as J
from verba.operators import models as M
from verba.operators import registry as G
from verba.operators import report as R
from verba.operators import topics as TP
from verba.plans import classify as C
from verba.sources import io as IO


def test_row_index_with_payload_beyond_a_million_rows(spark):
    n = 1_200_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    got = IO.assign_row_index(df, ["k"], 16)
    r = got.agg(F.count_distinct("row_index").alias("d"), F.min("row_index").alias("lo"), F.max("row_index").alias("hi")).first()
    assert (r.d, r.lo, r.hi) == (n, 0, n - 1)


def test_index_within_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("job"), F.col("id").alias("o"))
    rows = IO.index_within(df, "job", ["o"]).collect()
    hot = sorted(r.row_index for r in rows if r.job == 7)
    n = sum(1 for i in range(3000) if i % 3 == 0 or i == 7)
    assert hot == list(range(n)) and all(r.row_index == 0 for r in rows if r.job != 7)


def test_batches_of_a_bucket_do_not_replace_each_other(spark):
    path = IO.scratch_path(spark, "probe")
    df = spark.range(20).select("id", (F.col("id") % 2).alias("bucket"), (F.col("id") >= 10).cast("int").alias("batch"))
    for b in (0, 1, 1):
        IO.write_results(df.where(F.col("batch") == b), path, ["bucket", "batch"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(20))


def test_csv_round_trip_keeps_spaces_and_na_strings(spark):
    path = IO.scratch_path(spark, "probe")
    IO.write_csv(spark.createDataFrame([(1, "  a \n b "), (2, "n/a"), (3, '"q", r')], "i long, text string"), path)
    got = {r.i: r.text for r in IO.read_csv_texts(spark, path, "i long, text string", multi_line=True).collect()}
    assert got == {1: "  a \n b ", 2: None, 3: '"q", r'}


def test_failed_first_batch_and_totals(spark):
    jobs = spark.createDataFrame([(1, 20)], "job_id long, total_rows long")
    batches = spark.createDataFrame([(1, 1, 0), (1, 2, 8)], "job_id long, batch long, in_batch long")
    got = {r.batch: (r.processed_rows, r.progress_pct) for r in J.batch_progress(jobs, batches).collect()}
    assert got == {1: (0, 0.0), 2: (8, 40.0)}


def test_transitions_keep_jobs_without_results(spark):
    t = dt.datetime(2020, 1, 1)
    jobs = spark.createDataFrame([(1, "completed", t, t + dt.timedelta(seconds=9)), (2, "failed", t, t), (3, "processing", t, None)],
                                 "job_id long, status string, started_at timestamp, ended_at timestamp")
    res = spark.createDataFrame([(1, t + dt.timedelta(seconds=5), "row failed")], "job_id long, created_at timestamp, error_message string")
    got = {r.job_id: (r.final_status, r.processing_time) for r in J.job_transitions(jobs, res).collect()}
    assert got == {1: ("completed", 5), 2: ("failed", None), 3: ("processing", None)}
    assert J.job_results(jobs, res).count() == 3


def test_users_are_validated_first(spark):
    rows = [(1, "a@b.co", "x" * 300), (2, "a@b.co", "ok"), (3, "a@b.co", "later"), (4, None, "n"), (5, "c@d.co", "same"), (5, "c@d.co", "same"),
            (6, "old@b.co", "o")]
    batch = spark.createDataFrame(rows, "seq long, email string, full_name string")
    ins, rej = H.insert_new_users(spark.createDataFrame([("old@b.co",)], "email string"), batch)
    assert sorted((r.email, r.seq) for r in ins.collect()) == [("a@b.co", 2), ("c@d.co", 5)]
    bad = sorted((r.seq, r.reason) for r in rej.collect())
    assert [b[0] for b in bad] == [1, 3, 4, 5, 6] and [b[1] for b in bad if b[0] in (1, 4)] == ["Invalid email or name"] * 2


def test_selection_without_models_is_summed_up(spark):
    reg = G.registry_df(spark)
    sel = spark.createDataFrame([(1, "spam", None)], "request_id long, task string, model_key string")
    assert R.selection_summary(sel, reg).first().summary == "No model selected (will use all models)"
    with pytest.raises(ValueError):
        G.resolve_selection("spam", [])


def test_vectors_without_direction_keep_their_row(spark, sf):
    protos = TP.topic_prototypes(spark, sf)
    rows = [(1, [0.0] * 64), (2, None), (3, [1.0] * 64)]
    got = TP.score_topics(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), protos, ["vec_id"]).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3]


def test_caller_brings_the_language(spark, sf):
    docs = spark.createDataFrame([(1, "win a prize now, call today", "xx"), (2, "see you", None)], "doc_id long, text string, code string")
    got = {r.doc_id: r.language for r in C.classify_table(spark, sf, docs, language_col="code").collect()}
    assert got == {1: "xx", 2: "unknown"}


def test_classify_keeps_rows_with_equal_and_missing_ids(spark, sf):
    rows = [(1, "win a prize now, call today"), (1, "see you at lunch tomorrow"), (None, "hello there my friend"), (2, None)]
    got = C.classify_table(spark, sf, spark.createDataFrame(rows, "doc_id long, text string"), temperature=None).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"] and all(r.temperature == 1.0 for r in got)


def test_training_reads_all_rows_by_default(spark, tmp_path):
    from verba.operators import language as L

    docs = [(5 * k, "ein kleines haus am see", "de") for k in range(4)] + [(5 * k + 1, "a little house by the lake", "en") for k in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), 0) for i, _, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vecs = [(5, [1.0, 0.0], 3), (6, [0.0, 1.0], 4)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf = str(tmp_path)
    assert L.language_profiles(spark, sf).classes == ["de", "en"]
    assert M.task_corpus(spark, sf, "spam").count() == 8
    model = M.train_task_models(spark, sf, "spam", ["roberta-sms"])[0]
    assert model.weights.where("f = 'haus'").count() == 1
    assert {r.label for r in TP.topic_prototypes(spark, sf).collect()} == {3, 4}
