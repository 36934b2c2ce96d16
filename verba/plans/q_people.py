"""Queries and DuckDB oracles for history (HIS1-9), reporting (RPT1-9) and validation (VAL1-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.functions import text as T
from verba.operators import history as H
from verba.operators import registry as M
from verba.operators import report as R
from verba.operators import topics as TP
from verba.operators import validate as V
from verba.plans import q_models as QM
from verba.plans import sql_models as SM
from verba.plans import sql_text as S
from verba.plans.q_jobs import HIST_SQL, RESULTS_SQL, USERS_SQL
from verba.sources import io as IO
from verba.sources import tables as TB
from verba.sources.tables import load

PAGE, PAGE_SIZE, ONE_USER = 2, 10, 42
_WS = T.WS_CLASS


# ------------------------------------------------------------------ HIS

def q_history_count(spark, sf):
    return H.history_count(TB.history(spark, sf))


def q_history_page(spark, sf):
    return H.history_page(TB.history(spark, sf), ONE_USER, PAGE, PAGE_SIZE).select("id", "created_at", "prediction")


def _clustered(spark, sf):
    path = IO.scratch_path(spark, "clustered")
    H.write_clustered(TB.history(spark, sf).select("id", "user_id", "prediction", "created_at"), path)
    return spark.read.parquet(path)


def q_history_seek_page(spark, sf):
    """The page that history_page cuts by OFFSET, reached by the last key of the page before."""
    h, after = _clustered(spark, sf), None
    for _ in range(PAGE - 1):
        page = H.history_after(h, ONE_USER, after, PAGE_SIZE).select("created_at", "id").collect()  # a page
        after = tuple(page[-1]) if page else after
    return H.history_after(h, ONE_USER, after, PAGE_SIZE).select("id", "created_at", "prediction")


def q_lookup_clustered(spark, sf):
    return H.lookup_by_key(_clustered(spark, sf), TB.history(spark, sf).where("id % 500 = 7").select("id"), "id").select("id", "user_id")


def q_history_pages_all_users(spark, sf):
    return H.history_pages_all_users(TB.history(spark, sf), PAGE, PAGE_SIZE).select("user_id", "id", "rn")


def q_history_total_pages(spark, sf):
    return H.history_total_pages(TB.history(spark, sf), PAGE_SIZE)


def _delete_requests(spark, sf):
    h = TB.history(spark, sf).filter(F.col("id") % 11 == 0)
    requester = F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1)
    return h.select(F.col("id").alias("request_id"), F.col("id").alias("item_id"), requester.alias("requester"))


def q_delete_history_item(spark, sf):
    _kept, outcome = H.delete_history_items(TB.history(spark, sf), _delete_requests(spark, sf))
    return outcome


def q_delete_all_history(spark, sf):
    users = load(spark, sf, "customer").filter(F.col("c_custkey") % 10 == 3).select(F.col("c_custkey").alias("user_id"))
    _kept, per_user = H.delete_all_history(TB.history(spark, sf), users)
    return per_user


def q_active_user_results(spark, sf):
    return H.active_user_results(TB.history(spark, sf), TB.users(spark, sf)).select("id", "user_id")


def q_results_with_user(spark, sf):
    return H.results_with_user(TB.history(spark, sf), TB.users(spark, sf)).select("id", "user_id", "email", "is_active")


def q_lookup_by_key(spark, sf):
    keys = TB.users(spark, sf).filter(F.col("id") % 50 == 0).select("email")
    return H.lookup_by_key(TB.users(spark, sf), keys, "email").select("id", "email")


# ------------------------------------------------------------------ RPT

def q_confidence_band(spark, sf):
    h = TB.history(spark, sf)
    return h.select("id", SC.round6("confidence").alias("confidence"), R.confidence_band("confidence").alias("band"))


def q_ranked_scores(spark, sf):
    s = QM._task_scores(spark, sf, "sentiment").select("doc_id", "model_key", "label", "score")
    return R.ranked_scores(s, ["doc_id", "model_key"])


def q_chart_series(spark, sf):
    protos = TP.topic_prototypes(spark, sf)
    s = TP.score_topics(load(spark, sf, "embeddings"), protos, ["vec_id"])
    series = R.chart_series(SC.rescale_probabilities("probs_0", 1.0), M.TOPIC_LABELS)
    return s.select("vec_id", F.posexplode(series).alias("pos", "p")).select(
        "vec_id", "pos", "p.label", "p.percent", "p.colour")


def _symbol_source(spark, sf):
    h = TB.history(spark, sf)
    task = F.element_at(F.array(*[F.lit(t) for t in M.TASKS]), (F.col("id") % 3 + 1).cast("int"))
    pred_map = F.create_map(*[F.lit(x) for x in ("click", "Positive", "view", "negative", "purchase", "spam",
                                                 "signup", "not_spam", "error", "neutral")])
    return h.select("id", task.alias("task"), F.element_at(pred_map, F.col("prediction")).alias("pred"))


def q_prediction_symbol(spark, sf):
    s = _symbol_source(spark, sf)
    return s.select("id", "task", "pred", R.prediction_symbol("task", "pred").alias("result_symbol"),
                    R.prediction_symbol("task", "pred", history_view=True).alias("history_symbol"))


def q_model_display_names(spark, sf):
    req = QM._requests(spark, sf).filter(F.col("sel_list").isNotNull() | F.col("sel_str").contains(","))
    keys = F.when(F.col("sel_list").isNotNull(), F.col("sel_list")).otherwise(F.split("sel_str", ",", -1))
    ex = req.select("conv_id", "task", F.posexplode(keys).alias("pos", "model_key"))
    return R.model_display_names(ex, M.registry_df(spark)).select("conv_id", "pos", "model_key", "display_name")


def q_results_preview(spark, sf):
    from pyspark.sql import Window

    # a window group limit before the shuffle: a job ships ten rows a task at most
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    li = load(spark, sf, "lineitem").withColumn("row_index", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    r = TB._result_columns(li.filter(F.col("row_index") <= 10), (F.col("row_index") - 1).cast("long").alias("row_index"))
    text = F.concat(F.lit("Result text for part number "), F.col("l_quantity").cast("int").cast("string"),
                    F.lit(" of the uploaded file"))
    return r.select("job_id", "row_index", T.preview_text(text, 50).alias("text_preview"), "prediction",
                    F.round(F.col("confidence") * 100, 1).alias("confidence_pct"),
                    F.round(F.col("processing_time") * 1000, 0).cast("long").alias("time_ms"))


def q_job_summary(spark, sf):
    jobs = TB.jobs(spark, sf).select("job_id", "batch_size")
    agg = TB.result_rows(spark, sf).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("processed_rows"), F.sum("processing_time").alias("processing_time"),
        F.count("error_message").alias("errors"))
    full = jobs.join(agg, "job_id", "left").fillna(0, subset=["processed_rows", "processing_time", "errors"])
    return full.select("job_id", "processed_rows", SC.round6("processing_time").alias("processing_time"),
                                           "batch_size", "errors")


def q_temperature_mode(spark, sf):
    e = load(spark, sf, "events")
    t = SC.clamp_temperature(F.col("value") / 200)
    return e.select("event_id", SC.round6(t).alias("t"), R.temperature_mode(t).alias("mode"))


def q_selection_summary(spark, sf):
    sel = M.resolve_model_selection(QM._requests(spark, sf), M.registry_df(spark))
    req = QM._requests(spark, sf).select(F.col("conv_id").alias("request_id"), "task")
    chosen = sel.filter(F.col("error").isNull()).select(F.col("conv_id").alias("request_id"), "model_key")
    return R.selection_summary(req.join(chosen, "request_id", "left"), M.registry_df(spark))


# ------------------------------------------------------------------ VAL

def q_profile_text_table(spark, sf):
    p = V.profile_text_table(load(spark, sf, "documents"), "text", "doc_id")
    return p.select("row_count", "null_count", "max_length", "columns",
                    F.array_join(F.transform("sample_texts", lambda t: F.substring(t, 1, 30)), " | ").alias("samples"))


def q_validate_text_table(spark, sf):
    d = load(spark, sf, "documents")
    variants = {
        "full": (d, "text", None),
        "short_only": (d.filter(F.col("n_chars") <= 10000), "text", None),
        "missing_column": (d, "body", None),
        "with_nulls": (d.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.col("text"))), "text", None),
        "empty": (d.filter(F.col("doc_id") < 0), "text", None),
        "row_cap": (d.filter(F.col("n_chars") <= 10000), "text", 500),
    }
    out = None
    for name, (df, col, cap) in variants.items():
        prof = V.profile_text_table(df, col, "doc_id")
        v = V.validate_text_table(prof, col, cap).select(F.lit(name).alias("variant"), "valid", "error")
        out = v if out is None else out.unionByName(v)
    return out


def _request_rows(spark, sf):
    d = load(spark, sf, "documents")
    task = F.element_at(F.array(*[F.lit(x) for x in ("sentiment", "spam", "topic", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    bs = F.element_at(F.array(*[F.lit(x) for x in (1, 4, 8, 16, 10, 64, 128, 256, 0)]), (F.col("doc_id") % 9 + 1).cast("int"))
    return d.select("doc_id", "text", task.alias("task"), ((F.col("doc_id") % 30) / 10.0).alias("temperature"),
                    bs.alias("batch_size"), (F.col("doc_id") % 120).alias("n_texts"))


def _failures(df):
    return df.withColumn("failed_rules", V.request_rule_failures(
        F.col("text"), F.col("task"), F.col("temperature"), F.col("batch_size"), F.col("n_texts")))


def q_validate_requests(spark, sf):
    r = _failures(_request_rows(spark, sf))
    return r.select("doc_id", F.array_join("failed_rules", ",").alias("failed"))


def q_split_valid_invalid(spark, sf):
    valid, invalid = V.split_valid_invalid(_failures(_request_rows(spark, sf)))
    return valid.unionByName(invalid).select("doc_id", "status", "error")


def q_text_length_flags(spark, sf):
    return load(spark, sf, "documents").select("doc_id", *V.text_length_flags("text"))


def q_clamp_temperature(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", SC.round6(SC.clamp_temperature(F.col("value") / 100)).alias("t"))


def _user_batch(spark, sf):
    u = TB.users(spark, sf)
    fresh = u.filter(F.col("id") % 3 != 0)
    resubmitted = u.filter(F.col("id") % 9 == 0)
    dupes = u.filter((F.col("id") % 3 != 0) & (F.col("id") % 10 == 1))
    bad = u.filter(F.col("id") % 3 != 0).filter(F.col("id") % 13 == 5).select(
        "id", F.regexp_replace("email", "@", "_at_").alias("email"), "full_name", "is_active")
    batch = (fresh.withColumn("seq", F.col("id"))
             .unionByName(resubmitted.withColumn("seq", F.col("id") + 2000000))
             .unionByName(dupes.withColumn("seq", F.col("id") + 1000000))
             .unionByName(bad.withColumn("seq", F.col("id") + 3000000)))
    return u.filter(F.col("id") % 3 == 0), batch


def q_insert_new_users(spark, sf):
    existing, batch = _user_batch(spark, sf)
    inserted, rejected = H.insert_new_users(existing, batch)
    return inserted.select("email", "seq", F.lit("inserted").alias("outcome")).unionByName(
        rejected.select("email", "seq", F.col("reason").alias("outcome")))


QUERIES = {
    "history_count": q_history_count,
    "history_page": q_history_page,
    "history_seek_page": q_history_seek_page,
    "lookup_clustered": q_lookup_clustered,
    "history_pages_all_users": q_history_pages_all_users,
    "history_total_pages": q_history_total_pages,
    "delete_history_item": q_delete_history_item,
    "delete_all_history": q_delete_all_history,
    "active_user_results": q_active_user_results,
    "results_with_user": q_results_with_user,
    "lookup_by_key": q_lookup_by_key,
    "confidence_band": q_confidence_band,
    "ranked_scores": q_ranked_scores,
    "chart_series": q_chart_series,
    "prediction_symbol": q_prediction_symbol,
    "model_display_names": q_model_display_names,
    "results_preview": q_results_preview,
    "job_summary": q_job_summary,
    "temperature_mode": q_temperature_mode,
    "selection_summary": q_selection_summary,
    "profile_text_table": q_profile_text_table,
    "validate_text_table": q_validate_text_table,
    "validate_requests": q_validate_requests,
    "split_valid_invalid": q_split_valid_invalid,
    "text_length_flags": q_text_length_flags,
    "clamp_temperature": q_clamp_temperature,
    "insert_new_users": q_insert_new_users,
}

# ------------------------------------------------------------------ oracles

_HU = f"WITH h AS {HIST_SQL}, u AS {USERS_SQL} "
_NEWEST = "ORDER BY created_at DESC, id DESC"
_TASK3 = "CASE id % 3 WHEN 0 THEN 'sentiment' WHEN 1 THEN 'spam' ELSE 'topic' END"
_PRED = ("CASE prediction WHEN 'click' THEN 'Positive' WHEN 'view' THEN 'negative' WHEN 'purchase' THEN 'spam' "
         "WHEN 'signup' THEN 'not_spam' WHEN 'error' THEN 'neutral' END")
_REQ_SQL = (
    "(SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'sentiment' WHEN 1 THEN 'spam' ELSE 'topic' END AS task, "
    "CASE conv_id % 5 WHEN 2 THEN string_split(CASE conv_id % 3 WHEN 0 THEN 'twitter-roberta,twitter-roberta-xml' "
    "WHEN 1 THEN 'roberta-sms,distilbert-sms' ELSE 'bart-mnli,deberta-nli' END, ',') "
    "WHEN 4 THEN ['unknown-model', CASE conv_id % 3 WHEN 0 THEN 'twitter-roberta-xml' WHEN 1 THEN 'distilbert-sms' "
    "ELSE 'deberta-nli' END] END AS keys FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE conv_id % 5 IN (2, 4))")


def _symbol_sql(history_view: bool) -> str:
    p = "lower(pred)"
    if history_view:
        senti = (f"CASE WHEN contains({p}, 'positive') THEN '😊' WHEN contains({p}, 'negative') THEN '😞' ELSE '😐' END")
    else:
        senti = f"CASE {p} WHEN 'positive' THEN '😊' WHEN 'negative' THEN '😞' WHEN 'neutral' THEN '😐' ELSE '🤔' END"
    return (f"CASE WHEN task = 'sentiment' THEN {senti} WHEN task = 'spam' THEN CASE WHEN {p} = 'spam' THEN '🚫' "
            "ELSE '✅' END ELSE '📝' END")


def _clamp(e):
    return f"greatest(0.5, least(2.0, {e}))"


def _profile_sql(src, col="text"):
    return (f"SELECT count(*) AS row_count, count(*) FILTER (WHERE {col} IS NULL) AS null_count, "
            f"max(length({col})) AS max_length FROM {src}")


def _validate_sql(name, src, col, cap=None):
    cols = "['doc_id', 'text', 'lang', 'source', 'n_chars']"
    if col not in ("text",):
        msg = S.q(f"Column '{col}' not found. Available columns: {cols}")
        return f"SELECT '{name}' AS variant, false AS valid, {msg} AS error"
    chk = (f"CASE WHEN row_count = 0 THEN 'CSV file is empty' WHEN null_count > 0 THEN 'Found ' || null_count || "
           f"' empty values in ''{col}'' column' WHEN max_length > 10000 THEN "
           "'Text too long. Maximum length is 10,000 characters, found ' || max_length ")
    if cap:
        chk += f"WHEN row_count > {cap} THEN 'Too many rows. Maximum is {cap:,} rows, found ' || row_count "
    chk += "END"
    return f"SELECT '{name}' AS variant, ({chk}) IS NULL AS valid, {chk} AS error FROM ({_profile_sql(src, col)}) p"


_REQ_ROWS = ("(SELECT doc_id, text, ['sentiment', 'spam', 'topic', 'other'][doc_id % 4 + 1] AS task, "
             "(doc_id % 30) / 10.0 AS temperature, [1, 4, 8, 16, 10, 64, 128, 256, 0][doc_id % 9 + 1] AS batch_size, "
             "doc_id % 120 AS n_texts FROM documents)")
_RULES = ("concat_ws(',', CASE WHEN text IS NULL OR length(text) < 1 OR length(text) > 10000 THEN 'text_length' END, "
          "CASE WHEN task NOT IN ('sentiment', 'spam', 'topic') THEN 'model_type' END, "
          "CASE WHEN NOT (temperature >= 0.5 AND temperature <= 2.0) THEN 'temperature' END, "
          "CASE WHEN batch_size NOT IN (1, 4, 8, 16, 64, 128, 256) THEN 'batch_size' END, "
          "CASE WHEN NOT (n_texts >= 1 AND n_texts <= 100) THEN 'texts_per_request' END)")

_USERS_BATCH = (
    f"WITH u AS {USERS_SQL}, ex AS (SELECT email FROM u WHERE id % 3 = 0), "
    "b AS (SELECT email, full_name, id AS seq FROM u WHERE id % 3 <> 0 UNION ALL "
    "SELECT email, full_name, id + 2000000 FROM u WHERE id % 9 = 0 UNION ALL "
    "SELECT email, full_name, id + 1000000 FROM u WHERE id % 3 <> 0 AND id % 10 = 1 UNION ALL "
    "SELECT replace(email, '@', '_at_'), full_name, id + 3000000 FROM u WHERE id % 3 <> 0 AND id % 13 = 5), "
    "ok AS (SELECT *, coalesce(regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), false) "
    "AND coalesce(length(full_name), 0) <= 255 AS shape_ok FROM b), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY email, shape_ok ORDER BY seq, full_name) AS k FROM ok) "
    "SELECT email, seq, CASE WHEN NOT shape_ok THEN 'Invalid email or name' WHEN k > 1 OR email IN (SELECT email FROM ex) "
    "THEN 'Email already registered' ELSE 'inserted' END AS outcome FROM ranked")

ORACLES = {
    "history_count": f"{_HU}SELECT user_id, count(*) AS total FROM h WHERE user_id IS NOT NULL GROUP BY user_id",
    "history_page": (f"{_HU}SELECT id, created_at, prediction FROM h WHERE user_id = {ONE_USER} {_NEWEST} "
                     f"LIMIT {PAGE_SIZE} OFFSET {(PAGE - 1) * PAGE_SIZE}"),
    "history_pages_all_users": (
        f"{_HU}SELECT user_id, id, rn FROM (SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id {_NEWEST}) "
        f"AS INTEGER) AS rn FROM h WHERE user_id IS NOT NULL) t WHERE rn > {(PAGE - 1) * PAGE_SIZE} AND rn <= {PAGE * PAGE_SIZE}"),
    "history_total_pages": (
        f"{_HU}SELECT user_id, count(*) AS total, CAST(ceil(count(*) / {PAGE_SIZE}) AS BIGINT) AS total_pages FROM h "
        "WHERE user_id IS NOT NULL GROUP BY user_id"),
    "delete_history_item": (
        f"{_HU}, r AS (SELECT id AS request_id, id AS item_id, CASE WHEN id % 2 = 0 THEN user_id ELSE user_id + 1 END "
        "AS requester FROM h WHERE id % 11 = 0) SELECT request_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.id = r.item_id "
        "AND h.user_id = r.requester) THEN 'deleted' ELSE 'History item not found' END AS outcome FROM r"),
    "delete_all_history": (
        f"{_HU}, du AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 10 = 3) SELECT du.user_id, "
        "count(h.id) AS deleted_count FROM du LEFT JOIN h ON h.user_id = du.user_id GROUP BY du.user_id"),
    "lookup_clustered": f"{_HU}SELECT id, user_id FROM h WHERE id % 500 = 7",
    "active_user_results": f"{_HU}SELECT id, user_id FROM h WHERE user_id IN (SELECT id FROM u WHERE is_active)",
    "results_with_user": f"{_HU}SELECT h.id, h.user_id, u.email, u.is_active FROM h LEFT JOIN u ON u.id = h.user_id",
    "lookup_by_key": f"{_HU}SELECT id, email FROM u WHERE email IN (SELECT email FROM u WHERE id % 50 = 0)",
    "confidence_band": (
        f"{_HU}SELECT id, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' "
        "WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM h"),
    "ranked_scores": QM._scores_sql(
        "sentiment", (1.0,), None,
        "doc_id, model_key, CAST(row_number() OVER (PARTITION BY doc_id, model_key ORDER BY score DESC, label) AS INTEGER) AS rank, label, "
        "round(score * 100, 2) AS percent, row_number() OVER (PARTITION BY doc_id, model_key ORDER BY score DESC, label) = 1 AS is_best"),
    "chart_series": QM._topic_sql().replace(
        "SELECT sc.id AS vec_id, sc.model_key, row_number() OVER (PARTITION BY sc.id, sc.model_key ORDER BY sc.score DESC, "
        "sc.label) AS rank, nm.name AS label, round(sc.score, 6) AS score FROM sc JOIN nm ON nm.label = sc.label",
        "SELECT sc.id AS vec_id, CAST(sc.label AS INTEGER) AS pos, nm.name AS label, round(sc.score * 100, 1) AS percent, "
        "CAST(sc.label % 10 AS INTEGER) AS colour FROM sc JOIN nm ON nm.label = sc.label WHERE sc.model_key = 'bart-mnli'"),
    "prediction_symbol": (
        f"SELECT id, task, pred, {_symbol_sql(False)} AS result_symbol, {_symbol_sql(True)} AS history_symbol FROM "
        f"(SELECT id, {_TASK3} AS task, {_PRED} AS pred FROM {HIST_SQL} h0) t"),
    "model_display_names": SM.with_([
        f"reg AS {QM._REG_SQL}", f"rq AS {_REQ_SQL}",
        "ex AS (SELECT conv_id, task, unnest(keys) AS model_key, CAST(unnest(range(len(keys))) AS INTEGER) AS pos FROM rq)"],
        "SELECT ex.conv_id, ex.pos, ex.model_key, coalesce(reg.display_name, ex.model_key) AS display_name FROM ex "
        "LEFT JOIN reg ON reg.task = ex.task AND reg.model_key = ex.model_key"),
    "results_preview": (
        "SELECT job_id, row_index, CASE WHEN length(t) > 50 THEN substring(t, 1, 50) || '...' ELSE t END AS text_preview, "
        "prediction, round(confidence * 100, 1) AS confidence_pct, CAST(round(processing_time * 1000, 0) AS BIGINT) AS time_ms "
        "FROM (SELECT *, 'Result text for part number ' || CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) || "
        f"' of the uploaded file' AS t FROM {RESULTS_SQL} r0 WHERE row_index < 10) r"),
    "job_summary": (
        "SELECT j.o_orderkey AS job_id, count(r.job_id) AS processed_rows, round(coalesce(sum(r.processing_time), 0), 6) AS processing_time, "
        "[1, 4, 8, 16, 64, 128, 256][j.o_orderkey % 7 + 1] AS batch_size, count(r.error_message) AS errors "
        f"FROM orders j LEFT JOIN {RESULTS_SQL} r ON r.job_id = j.o_orderkey GROUP BY j.o_orderkey"),
    "temperature_mode": (
        f"SELECT event_id, round({_clamp('value / 200')}, 6) AS t, CASE WHEN {_clamp('value / 200')} < 0.8 THEN "
        f"'high_confidence' WHEN {_clamp('value / 200')} <= 1.2 THEN 'balanced' ELSE 'exploratory' END AS mode FROM events"),
    "selection_summary": SM.with_(
        [f"reg AS {QM._REG_SQL}", "n AS (SELECT task, count(*) AS n FROM reg GROUP BY task)",
         f"sel AS ({QM.ORACLES['resolve_model_selection']})",
         "rq AS (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'sentiment' WHEN 1 THEN 'spam' ELSE 'topic' END "
         "AS task FROM conversations)",
         "k AS (SELECT rq.conv_id AS request_id, rq.task, count(sel.model_key) AS k, min(sel.model_key) AS only_key FROM rq "
         "LEFT JOIN sel ON sel.conv_id = rq.conv_id AND sel.error IS NULL GROUP BY rq.conv_id, rq.task)"],
        "SELECT k.request_id, k.task, k.k, n.n, CASE WHEN k.k = 0 THEN 'No model selected (will use all models)' "
        "WHEN k.k = 1 THEN 'Single model: ' || reg.display_name WHEN k.k = n.n THEN 'Ensemble: All ' || n.n || "
        "' models combined' ELSE 'Ensemble: ' || k.k || ' of ' || n.n || ' models combined' END AS summary "
        "FROM k JOIN n USING (task) LEFT JOIN reg ON reg.task = k.task AND reg.model_key = k.only_key"),
    "profile_text_table": (
        "SELECT count(*) AS row_count, count(*) FILTER (WHERE text IS NULL) AS null_count, "
        "CAST(max(length(text)) AS INTEGER) AS max_length, 'doc_id,text,lang,source,n_chars' AS columns, "
        "(SELECT string_agg(substring(text, 1, 30), ' | ' ORDER BY doc_id) FROM (SELECT doc_id, text FROM documents "
        "ORDER BY doc_id LIMIT 3) s) AS samples FROM documents"),
    "validate_text_table": " UNION ALL ".join([
        _validate_sql("full", "documents", "text"),
        _validate_sql("short_only", "(SELECT * FROM documents WHERE n_chars <= 10000) d", "text"),
        _validate_sql("missing_column", "documents", "body"),
        _validate_sql("with_nulls", "(SELECT CASE WHEN doc_id % 50 = 0 THEN NULL ELSE text END AS text FROM documents) d", "text"),
        _validate_sql("empty", "(SELECT * FROM documents WHERE doc_id < 0) d", "text"),
        _validate_sql("row_cap", "(SELECT * FROM documents WHERE n_chars <= 10000) d", "text", 500),
    ]),
    "validate_requests": f"SELECT doc_id, {_RULES} AS failed FROM {_REQ_ROWS} r",
    "split_valid_invalid": (
        f"SELECT doc_id, CASE WHEN {_RULES} = '' THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN {_RULES} = '' "
        f"THEN NULL ELSE 'invalid: ' || {_RULES} END AS error FROM {_REQ_ROWS} r"),
    "text_length_flags": (
        f"SELECT doc_id, length({SM.strip_ws('text')}) BETWEEN 1 AND 9 AS too_short, length(text) > 10000 AS too_long "
        "FROM documents"),
    "clamp_temperature": f"SELECT event_id, round({_clamp('value / 100')}, 6) AS t FROM events",
    "insert_new_users": _USERS_BATCH,
}
ORACLES["history_seek_page"] = ORACLES["history_page"]
