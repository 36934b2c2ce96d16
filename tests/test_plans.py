"""Physical-plan checks: no cartesian products, pushed-down scans, no shuffle in the flagship,
and the window group limit for page cuts."""

from verba.plans import q_jobs, q_models, q_people


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_no_cartesian_or_nested_loop(spark, sf):
    p = _plan(q_models.q_classify_table(spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns(spark, sf):
    p = _plan(q_jobs.q_save_user_results(spark, sf))
    assert "ReadSchema: struct<id:bigint,user_id:bigint>" in p  # not the prediction that was saved with them


def test_history_page_cut_uses_group_limit(spark, sf):
    df = q_people.q_history_pages_all_users(spark, sf)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_flagship_without_translations_shuffles_nothing(spark, sf):
    from verba.plans import classify as C
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for task in ("spam", "topic"):
        p = _plan(C.classify_table(spark, sf, docs, task=task))
        assert "Exchange" not in p and p.count("Scan") == 1, p


def test_translations_are_the_only_broadcast(spark, sf):
    p = _plan(q_models.q_classify_table(spark, sf))
    assert p.count("BroadcastExchange") == 1 and "ShuffleExchange" not in p


def test_narrow_text_scan_is_spread(spark, sf):
    from verba.sources.tables import load
    n = spark.sparkContext.defaultParallelism
    assert load(spark, sf, "documents").rdd.getNumPartitions() >= n
