"""Invariants of the scoring, ensemble and relational operators."""

import pytest
from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.operators import ensemble as E
from verba.plans import q_jobs, q_models


@pytest.fixture(scope="module")
def spam_long(spark, sf):
    return q_models._task_scores(spark, sf, "spam", (0.5, 1.0, 2.0)).cache()


def test_scores_sum_to_one(spam_long):
    sums = spam_long.groupBy("doc_id", "model_key", "t").agg(F.sum("score").alias("s")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-9 for r in sums)


def test_temperature_keeps_argmax_and_orders_top_score(spam_long):
    top = spam_long.groupBy("doc_id", "model_key", "t").agg(
        F.max_by("label", "score").alias("best"), F.max("score").alias("top"))
    piv = top.groupBy("doc_id", "model_key").pivot("t", [0.5, 1.0, 2.0]).agg(F.first("best"), F.first("top")).collect()
    for r in piv:
        vals = r.asDict()
        assert len({vals[k] for k in vals if k.endswith("first(best)")}) == 1
        tops = [vals[f"{t}_first(top)"] for t in ("0.5", "1.0", "2.0")]
        assert tops[0] >= tops[1] - 1e-12 >= tops[2] - 2e-12


def test_ensemble_of_one_is_the_model(spam_long):
    one = spam_long.filter((F.col("model_key") == "roberta-sms") & (F.col("t") == 1.0)).select(
        "doc_id", F.col("model_key").alias("model"), "label", "score")
    ens = E.ensemble_long(one, ["doc_id"]).select("doc_id", "prediction", "confidence")
    direct = one.groupBy("doc_id").agg(F.max("score").alias("top"))
    bad = ens.join(direct, "doc_id").filter(F.abs(F.col("confidence") - F.col("top")) > 1e-12).count()
    assert bad == 0


def test_ensemble_between_inputs(spam_long):
    s = spam_long.filter(F.col("t") == 1.0).select("doc_id", F.col("model_key").alias("model"), "label", "score")
    arr = s.groupBy("doc_id", "label").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("m"))
    assert arr.filter((F.col("m") < F.col("lo") - 1e-12) | (F.col("m") > F.col("hi") + 1e-12)).count() == 0


def test_softmax_array_matches_definition(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    p = df.select(SC.softmax("x", 2.0).alias("p")).first().p
    import math
    e = [math.exp(v / 2.0 - 1.5) for v in (1.0, 2.0, 3.0)]
    assert all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(p, e))


def test_progress_never_falls(spark, sf):
    rows = q_jobs.q_batch_progress(spark, sf).orderBy("job_id", "batch").collect()
    last = {}
    for r in rows:
        assert r.processed_rows >= last.get(r.job_id, 0)
        last[r.job_id] = r.processed_rows


def test_deleted_plus_kept_is_total(spark, sf):
    from verba.operators import history as H
    from verba.sources import tables as TB
    h = TB.history(spark, sf)
    users = spark.read.parquet(f"{sf}/customer.parquet").filter(F.col("c_custkey") % 10 == 3).select(
        F.col("c_custkey").alias("user_id"))
    kept, per_user = H.delete_all_history(h, users)
    deleted = per_user.agg(F.sum("deleted_count")).first()[0] or 0
    assert kept.count() + deleted == h.count()


def test_every_input_row_once(spark, sf):
    r = q_models.q_classify_table(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert r.count() == n == r.select("doc_id").distinct().count()


def test_models_of_loaded_tasks_only(spark):
    from verba.operators import registry as R
    loaded = spark.createDataFrame([("spam",), ("topic",), ("spam",)], "task string")
    rows = {(r.task, r.model_key): r.display_name for r in R.available_models(R.registry_df(spark), loaded).collect()}
    assert rows == {("spam", "distilbert-sms"): "Distilbert-base", ("spam", "roberta-sms"): "Roberta-base",
                    ("topic", "bart-mnli"): "Bart-large", ("topic", "deberta-nli"): "Deberta-small"}


def test_processed_language_option(spark, sf):
    from verba.plans import classify as C
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = C.classify_table(spark, sf, docs, report_processed_language=True)
    rows = r.select("language", "detected_language").collect()
    assert len(rows) == docs.count()
    assert all(x.detected_language is not None for x in rows)
