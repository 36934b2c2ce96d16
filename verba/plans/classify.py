"""MDL11 ``classify_table``: the flagship plan.

    scan -> clean (TXT9) -> language (LNG4: trigram sums of whole batches)
         -> translations of the caller, if there are any (LNG8: broadcast join under a measured bound)
         -> normalise (TXT13) -> every selected model's scores (sums of whole batches, plug-ins by slices)
         -> rescale by temperature (MDL9) -> ensemble of the models that answered (ENS1, ENS4) -> result row

Without translations and with models small enough to go along it is a projection of the scan: no shuffle.
Blank input, and a text that no model could score, keep their row as the failed-row result (MDL13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.functions import text as T
from verba.operators import ensemble as E
from verba.operators import language as L
from verba.operators import models as M
from verba.operators import topics as TP
from verba.operators.plugins import PluginModel
from verba.operators.registry import TOPIC_LABELS, resolve_selection
from verba.sources import tables as TB

FAILED_LABEL = "unknown"


def preprocess_table(spark: SparkSession, sf_dir: str, docs: DataFrame, lang_model=None, translations: DataFrame | None = None,
                     id_col: str = "doc_id", text_col: str = "text", language_col: str | None = None) -> DataFrame:
    """TXT14 over a table: blank -> ''; else clean -> language (LNG4) -> translate (LNG7/8) -> normalise.
    Returns (id, blank, language, model_text), one row per input row.
    ``translations``: (src_key, src_lang, translated); without, every text stays as it is.
    ``language_col``: languages that the caller brings; then none is detected (null: unknown)."""
    cleaned = F.col("cleaned") if "cleaned" in docs.columns else T.clean_text(F.col(text_col))
    given = [F.coalesce(F.col(language_col), F.lit(L.UNKNOWN)).alias("language")] if language_col else []
    d = docs.select(F.col(id_col).alias("id"), T.is_blank(F.col(text_col)).alias("blank"), F.coalesce(cleaned, F.lit("")).alias("cleaned"), *given)
    if not given:
        d = L.detect_language_pipeline(d, lang_model or L.language_profiles(spark, sf_dir), "cleaned")
    if translations is not None:
        d = L.apply_translations(d, translations, "cleaned", "language", L.route_for_translation("language", True), out="cleaned")
    return d.select("id", "blank", "language", T.normalize_text("cleaned").alias("model_text"))


def load_models(spark: SparkSession, sf_dir: str, task: str, keys: list, cleaned_docs: DataFrame | None = None) -> list:
    """The registry's models of a task among ``keys``, trained: count models, or the topic model for both of its keys."""
    if task == "topic":
        return [TP.train_topics(TP.topic_corpus(spark, sf_dir, cleaned_docs))]
    own = [k for k, _ in M.task_specs(task, keys)]
    return M.train_task_models(spark, sf_dir, task, own, cleaned_docs=cleaned_docs) if own else []


def with_answers(d: DataFrame, keys: list, models: list) -> DataFrame:
    """``d`` with a struct (probs, error, seconds) for each key of ``keys``, ``_a0``, ``_a1``, ..."""
    nb = [m for m in models if isinstance(m, M.CountModel)]
    d = M.with_sums(d, nb, F.col("model_text")) if nb else d
    topic = next((m for m in models if isinstance(m, TP.TopicModel)), None)
    if topic is not None:
        d = d.withColumn("_topic", topic.pairs(F.col("model_text")))
    none = F.lit(None).cast("string")
    for i, key in enumerate(keys):
        plug = next((m for m in models if isinstance(m, PluginModel) and m.key == key), None)
        if plug is not None:
            answer = plug.answers(F.col("model_text"))
        elif topic is not None and key in topic.keys:
            probs = F.col(f"_topic.probs_{topic.keys.index(key)}")
            answer = F.struct(probs.alias("probs"), F.when(probs.isNull(), F.lit("no words")).alias("error"), F.lit(0.0).alias("seconds"))
        else:
            at = next(k for k, m in enumerate(nb) if m.key == key)
            answer = F.struct(M.nb_probs(nb[at], f"_s{at}").alias("probs"), none.alias("error"), F.col(f"_s{at}.seconds").alias("seconds"))
        d = d.withColumn(f"_a{i}", answer)
    return d.drop("_topic", *[f"_s{k}" for k in range(len(nb))])


def classify_table(spark: SparkSession, sf_dir: str, docs: DataFrame, task: str = "spam", temperature: float = 1.0,
                   selection="all", translations: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                   models: list | None = None, lang_model=None, plugins: list[PluginModel] = (), cleaned_docs: DataFrame | None = None,
                   report_processed_language: bool = False, language_col: str | None = None) -> DataFrame:
    """A result row per row of ``docs`` for the task sentiment, spam or topic.

    ``selection``: models, by MDL2's rule, of the registry and of ``plugins`` (scorers of the caller).
    ``models``: trained models (load_models()); trained here if none are given, on ``cleaned_docs`` (documents
    with their cleaned text) if that is there.
    ``translations``: the caller's translations; none means that texts stay as they are.
    ``language_col``: the caller's languages, which replace detection, as for single requests.
    ``report_processed_language``: also add ``detected_language``, detected on the processed text, as the
    reference's batch mode reports it (quirk 2); ``language`` stays the source language.

    ``models_used`` are the selected models, ``models_answered`` those that scored the row; scores are the
    mean of these. ``error`` has the messages of the others. Where none answered, and for blank text, the
    row is the failed result: unknown, 0.0, no scores, no models used. ``processing_time`` is the row's share,
    in seconds, of its batches' scoring; it is measured and differs between runs."""
    keys = resolve_selection(task, selection, [p.key for p in plugins])
    detect = language_col is None or report_processed_language
    train = models is None
    if cleaned_docs is None and (train or (detect and lang_model is None)):
        cleaned_docs = TB.cleaned_documents(spark, sf_dir)
    models = [*(load_models(spark, sf_dir, task, keys, cleaned_docs) if train else models), *plugins]
    if detect:
        lang_model = lang_model or L.language_profiles(spark, sf_dir, cleaned_docs=cleaned_docs)
    t = 1.0 if temperature is None else float(temperature)
    t = min(SC.T_MAX, max(SC.T_MIN, t))  # VAL6: clamp everywhere

    d = preprocess_table(spark, sf_dir, docs, lang_model, translations, id_col, text_col, language_col)
    extra = []
    if report_processed_language:
        d = L.detect_language_pipeline(d, lang_model, "model_text", out="detected_language")
        extra = ["detected_language"]
    d = with_answers(d, keys, models)
    labels = TOPIC_LABELS if task == "topic" else [M.output_label(task, c) for c in M.TASK_CLASSES[task]]
    lab = F.array(*[F.lit(x) for x in labels])
    n = range(len(keys))
    d = d.select("id", "blank", "language", *extra, *[SC.rescale_probabilities(f"_a{i}.probs", t).alias(f"sc_{i}") for i in n],
                 F.array_join(F.filter(F.array(*[F.concat(F.lit(f"{k}: "), F.col(f"_a{i}.error")) for i, k in enumerate(keys)]),
                                       lambda e: e.isNotNull()), "; ").alias("error"),
                 sum((F.coalesce(F.col(f"_a{i}.seconds"), F.lit(0.0)) for i in n), F.lit(0.0)).alias("processing_time"))
    answered = F.filter(F.array(*[F.when(F.col(f"sc_{i}").isNotNull(), F.lit(k)) for i, k in enumerate(keys)]), lambda k: k.isNotNull())
    none = F.array().cast("array<string>")
    d = d.withColumn("ens", E.ensemble_arrays([F.col(f"sc_{i}") for i in n])).withColumn("models_answered", F.when(F.col("blank"), none).otherwise(answered))
    failed = F.size("models_answered") == 0
    return d.select(
        F.col("id").alias(id_col),
        F.when(failed, F.lit(FAILED_LABEL)).otherwise(SC.best_label(lab, "ens")).alias("prediction"),
        F.when(failed, F.lit(0.0)).otherwise(F.array_max("ens")).alias("confidence"),
        F.when(failed, F.create_map().cast("map<string,double>")).otherwise(F.map_from_arrays(lab, "ens")).alias("all_scores"),
        F.lit(t).alias("temperature"),
        (F.size("models_answered") > 1).alias("is_ensemble"),
        F.when(failed, none).otherwise(F.array(*[F.lit(k) for k in keys])).alias("models_used"),
        "models_answered",
        F.when(~failed, E.individual_results(labels, {k: F.col(f"sc_{i}") for i, k in enumerate(keys)})).alias("individual_results"),
        "language",
        *extra,
        "processing_time",
        F.when(F.col("blank"), F.lit("blank text")).otherwise(F.nullif("error", F.lit(""))).alias("error"),
    )
