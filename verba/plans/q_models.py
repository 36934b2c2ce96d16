"""Queries and DuckDB oracles for models, scoring, ensembles and the flagship (MDL1-13, ENS1-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.functions import text as T
from verba.operators import ensemble as E
from verba.operators import models as M
from verba.operators import registry as R
from verba.operators import topics as TP
from verba.operators.plugins import PluginModel
from verba.plans import classify as C
from verba.plans import sql_models as SM
from verba.plans import sql_text as S
from verba.sources.tables import load

TEMPS = (0.5, 1.0, 2.0)


def _docs_model_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", M.model_text("text").alias("mt"))


def _task_scores(spark, sf, task, temps=(1.0,), keys=None):
    """Long form (doc_id, model_key, t, pos, label, score) for the task's models.
    One cleaning pass (materialized) feeds training and scoring; every (model, T) pair comes
    out of ONE projection and one explode, so the scoring plan runs once."""
    from verba.sources.tables import cleaned_documents
    prepared = cleaned_documents(spark, sf)
    models = M.train_task_models(spark, sf, task, keys, cleaned_docs=prepared)
    docs = prepared.select("doc_id", T.normalize_text("cleaned").alias("mt"))
    s = M.score_nb(docs, models, "mt", ["doc_id"])
    lab = F.array(*[F.lit(x) for x in models[0].labels])
    combos = [F.struct(F.lit(m.key).alias("model_key"), F.lit(float(t)).alias("t"),
                       SC.rescale_probabilities(f"probs_{i}", t).alias("sc"))
              for i, m in enumerate(models) for t in temps]
    out = s.select("doc_id", F.explode(F.array(*combos)).alias("c")).select(
        "doc_id", "c.model_key", "c.t", F.posexplode("c.sc").alias("pos", "score"))
    return out.withColumn("label", F.element_at(lab, F.col("pos") + 1))


# ------------------------------------------------------------------ Spark queries

def q_available_models(spark, sf):
    corpus = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    text_tasks = corpus.select(F.explode(F.array(F.lit("sentiment"), F.lit("spam"))).alias("task")).distinct()
    emb = load(spark, sf, "embeddings").select(F.lit("topic").alias("task")).distinct()
    return R.available_models(R.registry_df(spark), text_tasks.unionByName(emb))


def _requests(spark, sf):
    """conversations as requests: task by conv_id % 3, selection by conv_id % 5 (FIXTURES §3)."""
    conv = load(spark, sf, "conversations").select("conv_id").distinct()
    first = F.element_at(F.array(*[F.lit(k) for t, k, _d, _x in R.REGISTRY[0::2]]), (F.col("conv_id") % 3 + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(k) for t, k, _d, _x in R.REGISTRY[1::2]]), (F.col("conv_id") % 3 + 1).cast("int"))
    task = F.element_at(F.array(*[F.lit(t) for t in R.TASKS]), (F.col("conv_id") % 3 + 1).cast("int"))
    r = F.col("conv_id") % 5
    sel_str = (F.when(r == 0, F.lit("all")).when(r == 1, first).when(r == 2, F.concat(first, F.lit(","), second))
               .when(r == 3, F.lit("unknown-model")))
    sel_list = F.when(r == 4, F.array(F.lit("unknown-model"), second))
    return conv.select("conv_id", task.alias("task"), sel_str.alias("sel_str"), sel_list.alias("sel_list"))


def q_resolve_model_selection(spark, sf):
    return R.resolve_model_selection(_requests(spark, sf), R.registry_df(spark))


def _weights_long(kind):
    """Weights of the models of one kind, of both text tasks."""
    def q(spark, sf):
        out = None
        for task in ("spam", "sentiment"):
            key = next(k for t, k, _d, x in R.REGISTRY if t == task and x == kind)
            m = M.train_task_models(spark, sf, task, [key])[0]
            lab = F.array(*[F.lit(x) for x in m.classes])
            rows = m.weights.select("f", F.posexplode("w").alias("pos", "w")).select(
                F.lit(task).alias("task"), "f", F.element_at(lab, F.col("pos") + 1).alias("label"), F.round("w", 6).alias("w"))
            out = rows if out is None else out.unionByName(rows)
        return out
    return q


def _scores_query(task):
    def q(spark, sf):
        s = _task_scores(spark, sf, task)
        return s.select("doc_id", "model_key", "label", SC.round6("score").alias("score"))
    return q


def q_score_topic_zero_shot(spark, sf):
    protos = TP.topic_prototypes(spark, sf)
    emb = load(spark, sf, "embeddings")
    s = TP.score_topics(emb, protos, ["vec_id"])
    lab = F.array(*[F.lit(x) for x in R.TOPIC_LABELS])
    keys = [k for t, k, _d, _x in R.REGISTRY if t == "topic"]
    order = F.array_sort(F.transform(F.col("c.sc"), lambda v, i: F.struct((-v).alias("s"), i.alias("pos"))))
    combos = [F.struct(F.lit(key).alias("model_key"), SC.rescale_probabilities(f"probs_{i}", 1.0).alias("sc"))
              for i, key in enumerate(keys)]
    out = s.select("vec_id", F.explode(F.array(*combos)).alias("c")).select("vec_id", "c.model_key", F.posexplode(order).alias("rank", "x"))
    return out.select("vec_id", "model_key", (F.col("rank") + 1).alias("rank"),
                      F.element_at(lab, F.col("x.pos") + 1).alias("label"), SC.round6(-F.col("x.s")).alias("score"))


def q_softmax_temperature(spark, sf):
    emb = load(spark, sf, "embeddings")
    x = emb.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"),
                   F.explode(F.array(*[F.lit(t) for t in TEMPS])).alias("t"))
    return x.select("vec_id", "t", F.posexplode(SC.softmax("x", F.col("t"))).alias("pos", "p")).select(
        "vec_id", "t", "pos", SC.round6("p").alias("p"))


def q_rescale_probabilities(spark, sf):
    s = _task_scores(spark, sf, "sentiment", TEMPS)
    return s.select("doc_id", "model_key", "t", "label", SC.round6("score").alias("score"))


def q_pick_best_label(spark, sf):
    models = M.train_task_models(spark, sf, "sentiment")
    s = M.score_nb(_docs_model_text(spark, sf), models, "mt", ["doc_id"])
    lab = F.array(*[F.lit(x) for x in models[0].labels])
    both = F.explode(F.array(*[F.struct(F.lit(m.key).alias("model_key"), SC.rescale_probabilities(f"probs_{i}", 1.0).alias("sc"))
                               for i, m in enumerate(models)]))
    return s.select("doc_id", both.alias("c")).select("doc_id", "c.model_key", SC.best_label(lab, "c.sc").alias("prediction"),
                                                      SC.round6(F.array_max("c.sc")).alias("confidence"))


def _result_columns(r):
    return r.select("doc_id", "prediction", SC.round6("confidence").alias("confidence"), "language", "is_ensemble",
                    F.array_join("models_used", ",").alias("models_used"))


def q_classify_table(spark, sf):
    from verba.sources.tables import cleaned_documents, translations
    docs = cleaned_documents(spark, sf)  # one cleaning pass, shared by training and classification
    return _result_columns(C.classify_table(spark, sf, docs, task="spam", temperature=1.0, cleaned_docs=docs,
                                            translations=translations(spark, sf, docs)))


def q_classify_sentiment(spark, sf):
    from verba.sources.tables import cleaned_documents
    docs = cleaned_documents(spark, sf)
    return _result_columns(C.classify_table(spark, sf, docs, task="sentiment", temperature=0.5, selection="twitter-roberta-xml", cleaned_docs=docs))


def q_classify_topic(spark, sf):
    from verba.sources.tables import cleaned_documents
    docs = cleaned_documents(spark, sf)
    return _result_columns(C.classify_table(spark, sf, docs, task="topic", cleaned_docs=docs))


def _with_blanks(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 3
    blanks = d.filter(F.col("doc_id") % 4 == 0).select(
        (-1 - F.col("doc_id")).alias("doc_id"),
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("")).otherwise(F.lit(" \t  ")).alias("text"))
    return d.unionByName(blanks)


def vowel_share_scorer(fails_every=None):
    """A caller's scorer: P(label 1) = (count of 'e' + 1) / (length + 2). It raises on texts whose length is a
    multiple of ``fails_every``."""
    def make():
        def score(texts):
            out = []
            for t in texts:
                if fails_every and len(t) % fails_every == 0:
                    raise ValueError("length")
                p = (t.count("e") + 1) / (len(t) + 2)
                out.append([1 - p, p])
            return out
        return score
    return make


def _plugin(fails_every=None):
    return PluginModel("vowels", ["not_spam", "spam"], vowel_share_scorer(fails_every))


def q_failed_row_result(spark, sf):
    """Blank texts, and texts on which the only model fails, keep their row."""
    d = _with_blanks(spark, sf).withColumn("code", F.lit("en"))
    r = C.classify_table(spark, sf, d, task="spam", selection="vowels", models=[], plugins=[_plugin(5)], language_col="code")
    return r.select("doc_id", "prediction", SC.round6("confidence").alias("confidence"), F.size("models_answered").alias("n_models"), "error")


def q_score_with_plugin(spark, sf):
    s = M.score_with_plugin(_docs_model_text(spark, sf), _plugin(50), "mt", ["doc_id"])
    lab = F.array(F.lit("not_spam"), F.lit("spam"))
    return s.select("doc_id", SC.best_label(lab, "scores").alias("prediction"), SC.round6(F.array_max("scores")).alias("confidence"), "error")


def _spam_long(spark, sf):
    s = _task_scores(spark, sf, "spam")
    return s.select("doc_id", F.col("model_key").alias("model"), "label", "score")


def q_ensemble_average(spark, sf):
    r = E.ensemble_long(_spam_long(spark, sf), ["doc_id"])
    return r.select("doc_id", "prediction", SC.round6("confidence").alias("confidence"), "n_models")


def q_ensemble_method_fallback(spark, sf):
    r = E.ensemble_long(_spam_long(spark, sf), ["doc_id"], method="weighted")
    return r.select("doc_id", "prediction", SC.round6("confidence").alias("confidence"), "method_used", "fallback")


def q_individual_results(spark, sf):
    s = _spam_long(spark, sf).filter(F.col("score").isNotNull())
    best = s.groupBy("doc_id", "model").agg(
        F.min_by(F.struct("label", "score"), F.struct((-F.col("score")).alias("ns"), F.col("label"))).alias("b"))
    from pyspark.sql import Window
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return best.withColumn("n", n).filter("n > 1").select(
        "doc_id", F.col("model").alias("model_key"), F.col("b.label").alias("label"),
        SC.round6("b.score").alias("confidence"))


def q_skip_failed_models(spark, sf):
    """Two trained models and a caller's scorer, which fails on a tenth of the texts: they are averaged without it."""
    from verba.sources.tables import cleaned_documents
    docs = cleaned_documents(spark, sf)
    r = C.classify_table(spark, sf, docs, task="spam", cleaned_docs=docs, plugins=[_plugin(10)], language_col="lang")
    return r.select("doc_id", "prediction", SC.round6("confidence").alias("confidence"), F.size("models_answered").alias("n_models"))


QUERIES = {
    "available_models": q_available_models,
    "resolve_model_selection": q_resolve_model_selection,
    "train_word_model": _weights_long("word"),
    "train_char_model": _weights_long("char"),
    "score_sentiment": _scores_query("sentiment"),
    "score_spam": _scores_query("spam"),
    "score_topic_zero_shot": q_score_topic_zero_shot,
    "softmax_temperature": q_softmax_temperature,
    "rescale_probabilities": q_rescale_probabilities,
    "pick_best_label": q_pick_best_label,
    "classify_table": q_classify_table,
    "classify_sentiment": q_classify_sentiment,
    "classify_topic": q_classify_topic,
    "score_with_plugin": q_score_with_plugin,
    "failed_row_result": q_failed_row_result,
    "ensemble_average": q_ensemble_average,
    "ensemble_method_fallback": q_ensemble_method_fallback,
    "individual_results": q_individual_results,
    "skip_failed_models": q_skip_failed_models,
}

# ------------------------------------------------------------------ oracles

_REG_SQL = SM.values([(t, k, d, i) for i, (t, k, d, _x) in enumerate(R.REGISTRY)], ["task", "model_key", "display_name", "reg_pos"])
_DOCS_MT = f"src AS MATERIALIZED (SELECT doc_id AS id, {SM.model_text('text')} AS t FROM documents)"


def _task_scores_sql(task, temps=(1.0,), keys=None):
    ctes, sels = [_DOCS_MT], []
    for t_, key, _d, kind in R.REGISTRY:
        if t_ != task or (keys and key not in keys):
            continue
        p = key.replace("-", "_")
        ctes += SM.nb_train_ctes(task, kind, p)
        for j, t in enumerate(temps):
            out = f"{p}_s{j}"
            ctes += SM.nb_score_ctes(kind, p, "src", out, repr(float(t)))
            sels.append(f"SELECT id AS doc_id, '{key}' AS model_key, CAST({float(t)} AS DOUBLE) AS t, k, out_label AS label, prob, score "
                        f"FROM {out}")
    return ctes, " UNION ALL ".join(sels)


def _scores_sql(task, temps=(1.0,), keys=None, select="doc_id, model_key, label, round(score, 6) AS score"):
    ctes, body = _task_scores_sql(task, temps, keys)
    return SM.with_(ctes + [f"sc AS ({body})"], f"SELECT {select} FROM sc")


def _ensemble_sql(select, more=None):
    """``more``: (CTEs, select of doc_id, model_key, label, score) of a further model."""
    ctes, body = _task_scores_sql("spam")
    ctes += more[0] if more else []
    ctes += [
        f"sc AS (SELECT doc_id, model_key, label, score FROM ({body}) b" + (f" UNION ALL {more[1]})" if more else ")"),
        "ok AS (SELECT * FROM sc WHERE score IS NOT NULL)",
        "nm AS (SELECT doc_id, count(DISTINCT model_key) AS n_models FROM ok GROUP BY doc_id)",
        "av AS (SELECT o.doc_id, o.label, sum(o.score) / n.n_models AS score, n.n_models FROM ok o JOIN nm n USING (doc_id) "
        "GROUP BY o.doc_id, o.label, n.n_models)",
        "best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rk FROM av)",
    ]
    return SM.with_(ctes, f"SELECT {select} FROM best WHERE rk = 1")


def _topic_sql():
    labels = SM.values([(i, x) for i, x in enumerate(R.TOPIC_LABELS)], ["label", "name"])
    return SM.with_([
        "ex AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS dim "
        "FROM embeddings)",
        "pr AS (SELECT label, dim, avg(x) AS p FROM ex GROUP BY label, dim)",
        "j AS (SELECT e.vec_id, p.label, sum(e.x * p.p) AS dot, sum(p.p * p.p) AS pp, sum(e.x * e.x) AS xx, "
        "sum((e.x - p.p) * (e.x - p.p)) AS d2 FROM ex e JOIN pr p ON p.dim = e.dim GROUP BY e.vec_id, p.label)",
        "raw AS (SELECT vec_id AS id, label, 'bart-mnli' AS model_key, dot / (sqrt(xx) * sqrt(pp)) AS logit FROM j "
        "UNION ALL SELECT vec_id AS id, label, 'deberta-nli' AS model_key, -d2 AS logit FROM j)",
        *SM.softmax_ctes("raw", "pr1", ["id", "label", "model_key"], "logit", "prob", "id, model_key"),
        "l2 AS (SELECT id, label, model_key, ln(greatest(1e-8, least(1 - 1e-8, prob))) / 1.0 AS z FROM pr1)",
        *SM.softmax_ctes("l2", "sc", ["id", "label", "model_key"], "z", "score", "id, model_key"),
        f"nm AS {labels}",
    ], "SELECT sc.id AS vec_id, sc.model_key, row_number() OVER (PARTITION BY sc.id, sc.model_key ORDER BY sc.score DESC, "
       "sc.label) AS rank, nm.name AS label, round(sc.score, 6) AS score FROM sc JOIN nm ON nm.label = sc.label")


def _selection_sql():
    first = "CASE conv_id % 3 WHEN 0 THEN 'twitter-roberta' WHEN 1 THEN 'roberta-sms' ELSE 'bart-mnli' END"
    second = "CASE conv_id % 3 WHEN 0 THEN 'twitter-roberta-xml' WHEN 1 THEN 'distilbert-sms' ELSE 'deberta-nli' END"
    task = "CASE conv_id % 3 WHEN 0 THEN 'sentiment' WHEN 1 THEN 'spam' ELSE 'topic' END"
    return SM.with_([
        f"reg AS {_REG_SQL}",
        f"rq AS (SELECT conv_id, {task} AS task, CASE conv_id % 5 WHEN 0 THEN 'all' WHEN 1 THEN {first} "
        f"WHEN 2 THEN {first} || ',' || {second} WHEN 3 THEN 'unknown-model' END AS sel_str, "
        f"CASE WHEN conv_id % 5 = 4 THEN ['unknown-model', {second}] END AS sel_list "
        "FROM (SELECT DISTINCT conv_id FROM conversations) c)",
        "r2 AS (SELECT *, sel_list IS NULL AND coalesce(sel_str = 'all', true) AS is_all, sel_list IS NULL AND sel_str <> 'all' AND NOT contains(sel_str, ',') "
        "AS single FROM rq)",
        "r3 AS (SELECT *, CASE WHEN single THEN [sel_str] WHEN sel_list IS NOT NULL THEN sel_list "
        "ELSE string_split(sel_str, ',') END AS keys FROM r2 WHERE NOT is_all)",
        "ex AS (SELECT conv_id, task, single, sel_str, unnest(keys) AS model_key, unnest(range(len(keys))) AS pos FROM r3)",
        "known AS (SELECT conv_id, CAST(pos AS INTEGER) AS pos, model_key FROM ex "
        "WHERE EXISTS (SELECT 1 FROM reg WHERE reg.task = ex.task AND reg.model_key = ex.model_key))",
        "allr AS (SELECT r2.conv_id, CAST(reg.reg_pos AS INTEGER) AS pos, reg.model_key FROM r2 JOIN reg ON reg.task = r2.task "
        "WHERE r2.is_all)",
        "err AS (SELECT conv_id, NULL::INTEGER AS pos, NULL::VARCHAR AS model_key, CASE WHEN single THEN "
        "'Model ''' || sel_str || ''' not available for type ''' || task || '''' ELSE "
        "'None of the specified models are available for type ''' || task || '''' END AS error FROM r3 "
        "WHERE conv_id NOT IN (SELECT conv_id FROM known))",
    ], "SELECT conv_id, pos, model_key, NULL::VARCHAR AS error FROM allr UNION ALL "
       "SELECT conv_id, pos, model_key, NULL::VARCHAR AS error FROM known UNION ALL SELECT * FROM err")


def _classify_sql(task="spam", keys=None, translated=True, t="1.0"):
    ctes = SM.lang_model_ctes()
    ctes += [
        f"c AS (SELECT doc_id AS id, coalesce({S.clean_text('text')}, '') AS cleaned FROM documents)",
        f"src0 AS (SELECT id, cleaned, {SM.pdt('cleaned')} AS dt0 FROM c)",
        "src_l AS (SELECT id, CASE WHEN length(trim(cleaned, ' ')) < 10 OR length(dt0) < 5 THEN NULL ELSE dt0 END AS dt "
        "FROM src0)",
    ]
    ctes += SM.lang_score_ctes("src_l", "det")
    ctes += [
        f"lg AS (SELECT id, CASE WHEN detected IS NULL THEN 'unknown' ELSE {SM.lang_code_map('detected')} END AS language "
        "FROM det)",
        f"tr0 AS (SELECT sha256({S.clean_text('text')}) AS src_key, lang AS src_lang, doc_id, "
        f"CASE WHEN doc_id % 3 = 0 THEN 'en: ' || {S.clean_text('text')} ELSE '  ' END AS translated "
        "FROM documents WHERE lang <> 'en' AND doc_id % 3 <> 2)",
        "tr AS (SELECT src_key, src_lang, arg_min(translated, doc_id) AS translated FROM tr0 GROUP BY src_key, src_lang)",
        "tx AS (SELECT id, lg.language, c.cleaned AS translated FROM c JOIN lg USING (id))" if not translated else
        "tx AS (SELECT c.id, lg.language, CASE WHEN lg.language NOT IN ('en', 'unknown') "
        f"THEN coalesce(nullif({SM.strip_ws('tr.translated')}, ''), c.cleaned) ELSE c.cleaned END AS translated "
        "FROM c JOIN lg USING (id) LEFT JOIN tr ON tr.src_key = sha256(c.cleaned) AND tr.src_lang = lg.language)",
        f"src AS MATERIALIZED (SELECT id, {S.normalize_text('translated')} AS t FROM tx)",
    ]
    sels, used = [], []
    for t_, key, _d, kind in R.REGISTRY:
        if t_ != task or (keys and key not in keys):
            continue
        p = key.replace("-", "_")
        ctes += SM.nb_train_ctes(task, kind, p)
        ctes += SM.nb_score_ctes(kind, p, "src", f"{p}_s", t)
        sels.append(f"SELECT id, out_label AS label, score FROM {p}_s")
        used.append(key)
    ctes += [
        f"allsc AS ({' UNION ALL '.join(sels)})",
        f"av AS (SELECT id, label, sum(score) / {len(used)} AS score FROM allsc GROUP BY id, label)",
        "best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rk FROM av)",
    ]
    blank = f"(text IS NULL OR regexp_replace(text, {S.q(S.T.WS_CLASS + '+')}, '', 'g') = '')"
    return SM.with_(ctes, (
        "SELECT b.id AS doc_id, CASE WHEN d.blank THEN 'unknown' ELSE b.label END AS prediction, "
        "round(CASE WHEN d.blank THEN 0.0 ELSE b.score END, 6) AS confidence, lg.language, "
        f"NOT d.blank AND {len(used) > 1} AS is_ensemble, CASE WHEN d.blank THEN '' ELSE '{','.join(used)}' END AS models_used "
        f"FROM best b JOIN lg USING (id) JOIN (SELECT doc_id AS id, {blank} AS blank FROM documents) d USING (id) "
        "WHERE b.rk = 1"))


def _plugin_ctes(src, fails_every, out="pl"):
    """(id, label, k, score) of the vowel scorer, without the texts on which it fails."""
    return [
        f"{out}_p AS (SELECT id, (length(t) - length(replace(t, 'e', '')) + 1) / (length(t) + 2) AS p1 FROM {src} WHERE length(t) % {fails_every} <> 0)",
        f"{out}_lf AS (SELECT id, 'not_spam' AS label, 1 AS k, 1 - p1 AS prob FROM {out}_p UNION ALL "
        f"SELECT id, 'spam' AS label, 2 AS k, p1 AS prob FROM {out}_p)",
        *SM.rescale_ctes(f"{out}_lf", out, "1.0", ["id", "label", "k", "prob"]),
    ]


def _failed_sql():
    blanks = ("(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id AS doc_id, CASE doc_id % 3 WHEN 0 THEN NULL "
              "WHEN 1 THEN '' ELSE ' ' || chr(9) || chr(160) || ' ' END AS text FROM documents WHERE doc_id % 4 = 0)")
    blank = f"(text IS NULL OR regexp_replace(text, {S.q(S.T.WS_CLASS + '+')}, '', 'g') = '')"
    return SM.with_([
        f"inp AS (SELECT doc_id, {blank} AS blank, {SM.model_text('coalesce(text, ' + chr(39) * 2 + ')')} AS t FROM {blanks} b)",
        "src AS MATERIALIZED (SELECT doc_id AS id, t FROM inp)", *_plugin_ctes("src", 5),
        "best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS rk FROM pl)"],
        "SELECT i.doc_id, CASE WHEN i.blank OR b.id IS NULL THEN 'unknown' ELSE b.label END AS prediction, "
        "round(CASE WHEN i.blank OR b.id IS NULL THEN 0.0 ELSE b.score END, 6) AS confidence, "
        "CASE WHEN i.blank OR b.id IS NULL THEN 0 ELSE 1 END AS n_models, CASE WHEN i.blank THEN 'blank text' "
        "WHEN b.id IS NULL THEN 'vowels: ValueError: length' END AS error FROM inp i LEFT JOIN best b ON b.id = i.doc_id AND b.rk = 1")


def _plugin_sql():
    return SM.with_([
        _DOCS_MT, *_plugin_ctes("src", 50),
        "best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS rk FROM pl)",
    ], "SELECT s.id AS doc_id, b.label AS prediction, round(b.score, 6) AS confidence, "
       "CASE WHEN b.id IS NULL THEN 'ValueError: length' END AS error FROM src s LEFT JOIN best b ON b.id = s.id AND b.rk = 1")


def _weights_sql(kind):
    ctes, sels = [], []
    for task in ("spam", "sentiment"):
        ctes += SM.nb_train_ctes(task, kind, f"m_{task}")
        sels.append(f"SELECT '{task}' AS task, f, label, round(w, 6) AS w FROM m_{task}_w")
    return SM.with_(ctes, " UNION ALL ".join(sels))


ORACLES = {
    "available_models": SM.with_([
        f"reg AS {_REG_SQL}",
        "loaded AS (SELECT unnest(['sentiment', 'spam']) AS task FROM labels l JOIN documents d ON d.doc_id = l.doc_id "
        "UNION ALL SELECT 'topic' AS task FROM embeddings)",
        "lt AS (SELECT DISTINCT task FROM loaded)",
        "pt AS (SELECT task, count(*) AS models_in_task FROM reg GROUP BY task)",
    ], "SELECT reg.task, reg.model_key, reg.display_name, pt.models_in_task, CASE reg.task WHEN 'sentiment' THEN "
       "'Sentiment Analysis (Positive/Negative/Neutral)' WHEN 'spam' THEN 'Spam Detection (Spam/Not Spam)' ELSE 'Topic Classification' "
       "END AS description, CASE reg.task WHEN 'sentiment' THEN 'en,multilingual,auto' ELSE 'en,auto' END AS languages FROM reg JOIN lt USING (task) JOIN pt USING (task)"),
    "resolve_model_selection": _selection_sql(),
    "train_word_model": _weights_sql("word"),
    "train_char_model": _weights_sql("char"),
    "score_sentiment": _scores_sql("sentiment"),
    "score_spam": _scores_sql("spam"),
    "score_topic_zero_shot": _topic_sql(),
    "softmax_temperature": SM.with_([
        "ex AS (SELECT vec_id, t, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos "
        "FROM embeddings, (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS t) tt)",
        "ex2 AS (SELECT vec_id, t, pos, x / t AS z FROM ex)",
        *SM.softmax_ctes("ex2", "sm", ["vec_id", "t", "pos"], "z", "p", "vec_id, t"),
    ], "SELECT vec_id, t, CAST(pos AS INTEGER) AS pos, round(p, 6) AS p FROM sm"),
    "rescale_probabilities": _scores_sql("sentiment", TEMPS, None, "doc_id, model_key, t, label, round(score, 6) AS score"),
    "pick_best_label": SM.with_(
        _task_scores_sql("sentiment")[0]
        + [f"sc AS ({_task_scores_sql('sentiment')[1]})",
           "b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, model_key ORDER BY score DESC, k) AS rk FROM sc)"],
        "SELECT doc_id, model_key, label AS prediction, round(score, 6) AS confidence FROM b WHERE rk = 1"),
    "classify_table": _classify_sql(),
    "classify_sentiment": _classify_sql("sentiment", ["twitter-roberta-xml"], False, "0.5"),
    "score_with_plugin": _plugin_sql(),
    "failed_row_result": _failed_sql(),
    "ensemble_average": _ensemble_sql("doc_id, label AS prediction, round(score, 6) AS confidence, n_models"),
    "ensemble_method_fallback": _ensemble_sql(
        "doc_id, label AS prediction, round(score, 6) AS confidence, 'average' AS method_used, true AS fallback"),
    "individual_results": SM.with_(
        _task_scores_sql("spam")[0] + [
            f"sc AS ({_task_scores_sql('spam')[1]})",
            "b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, model_key ORDER BY score DESC, label) AS rk FROM sc)",
            "n AS (SELECT doc_id, count(DISTINCT model_key) AS n FROM sc GROUP BY doc_id)"],
        "SELECT b.doc_id, b.model_key, b.label, round(b.score, 6) AS confidence FROM b JOIN n USING (doc_id) "
        "WHERE b.rk = 1 AND n.n > 1"),
    "skip_failed_models": _ensemble_sql(
        "doc_id, label AS prediction, round(score, 6) AS confidence, n_models",
        (_plugin_ctes("src", 10), "SELECT id, 'vowels', label, score FROM pl")),
}
