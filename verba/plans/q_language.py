"""Queries and DuckDB oracles for language identification and translation (LNG1-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verba.functions import text as T
from verba.operators import language as L
from verba.plans import sql_models as SM
from verba.plans import sql_text as S
from verba.session import materialize
from verba.sources.tables import load, translations


def _docs(spark, sf):
    return load(spark, sf, "documents")


def q_train_language_profiles(spark, sf):
    m = L.language_profiles(spark, sf)
    cls = F.array(*[F.lit(c) for c in m.classes])
    return m.weights.select(
        F.col("f").alias("g"), F.posexplode("w").alias("pos", "w")
    ).select("g", F.element_at(cls, F.col("pos") + 1).alias("lang"), F.round("w", 6).alias("w"))


def q_score_languages(spark, sf):
    from verba.sources.tables import cleaned_documents
    docs = cleaned_documents(spark, sf)  # one cleaning pass shared by training and scoring
    m = L.language_profiles(spark, sf, cleaned_docs=docs)
    d = docs.select("doc_id", "lang", L.pipeline_detector_text("cleaned").alias("dt"))
    s = L.score_languages(d, m, "dt", ["doc_id", "lang"])
    return s.select("doc_id", "lang", "detected", "n_grams")


def q_detect_language_request(spark, sf):
    m = L.language_profiles(spark, sf)
    return L.detect_language_request(_docs(spark, sf).select("doc_id", "text"), m, "text").select("doc_id", "language")


def q_detect_language_pipeline(spark, sf):
    from verba.sources.tables import cleaned_documents
    docs = cleaned_documents(spark, sf)
    m = L.language_profiles(spark, sf, cleaned_docs=docs)
    d = docs.select("doc_id", "cleaned")
    return L.detect_language_pipeline(d, m, "cleaned").select("doc_id", "language")


def _code_variants(spark, sf):
    d = _docs(spark, sf)
    k = F.col("doc_id") % 6
    code = (F.when(k == 0, F.lit("zh-cn")).when(k == 1, F.lit("zh-tw")).when(k == 2, F.lit("pt"))
            .otherwise(F.col("lang")))
    return d.select("doc_id", code.alias("code"))


_CODE_SQL = ("(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'zh-cn' WHEN 1 THEN 'zh-tw' WHEN 2 THEN 'pt' "
             "ELSE lang END AS code FROM documents)")


def q_map_language_code(spark, sf):
    return _code_variants(spark, sf).select("doc_id", "code", L.map_language_code("code").alias("mapped"))


def q_supported_language_filter(spark, sf):
    v = _code_variants(spark, sf).withColumn("code", F.when(F.col("doc_id") % 6 == 3, F.lit("xx")).otherwise(F.col("code")))
    return v.select("doc_id", "code", L.supported_language_flag("code").alias("is_supported"))


def _effective_lang(spark, sf):
    d = _docs(spark, sf)
    lang = F.when(F.col("n_chars") < 10, F.lit(L.UNKNOWN)).otherwise(F.col("lang"))
    return d.select("doc_id", "text", lang.alias("language"), (F.col("doc_id") % 2 == 0).alias("enabled"))


def q_route_for_translation(spark, sf):
    d = _effective_lang(spark, sf)
    return d.select("doc_id", "language", "enabled", L.route_for_translation("language", F.col("enabled")).alias("route"))


def q_apply_translations(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.col("lang").alias("language"), T.clean_text("text").alias("cleaned"))
    tr = translations(spark, sf)
    out = L.apply_translations(d, tr, "cleaned", "language", L.route_for_translation("language"))
    return out.select("doc_id", "language", (F.col("translated_text") != F.col("cleaned")).alias("changed"),
                      F.sha2("translated_text", 256).alias("text_hash"))


def stand_in_translator():
    """A caller's translator: 'en: ' and the text; it raises on texts whose length is a multiple of seven."""
    def translate(pairs):
        out = []
        for text, _language in pairs:
            if len(text) % 7 == 0:
                raise ValueError("length")
            out.append("en: " + text)
        return out
    return translate


def q_translate_with_memory(spark, sf):
    """Half of the documents, then all: what the first batch taught is not translated again."""
    from verba.operators.memory import TranslationMemory
    from verba.sources.io import scratch_path

    d = materialize(_docs(spark, sf).select("doc_id", F.col("lang").alias("language"), T.clean_text("text").alias("cleaned")))
    memory = TranslationMemory(spark, scratch_path(spark, "memory"))
    memory.learn(d.where("doc_id % 2 = 0"), "cleaned", "language", L.route_for_translation("language"), stand_in_translator, "first")
    out = memory.translate(d, "cleaned", "language", stand_in_translator, "all")
    return out.select("doc_id", "language", (F.col("translated_text") != F.col("cleaned")).alias("changed"),
                      F.sha2("translated_text", 256).alias("text_hash"))


QUERIES = {
    "train_language_profiles": q_train_language_profiles,
    "score_languages": q_score_languages,
    "detect_language_request": q_detect_language_request,
    "detect_language_pipeline": q_detect_language_pipeline,
    "map_language_code": q_map_language_code,
    "supported_language_filter": q_supported_language_filter,
    "route_for_translation": q_route_for_translation,
    "apply_translations": q_apply_translations,
    "translate_with_memory": q_translate_with_memory,
}


def _supported_sql(e):
    return f"({e} IN ({', '.join(S.q(x) for x in L.SUPPORTED_LANGUAGES)}))"


_LM = SM.lang_model_ctes()

ORACLES = {
    "translate_with_memory": SM.with_(
        [f"d AS (SELECT doc_id, lang AS language, {S.clean_text('text')} AS cleaned FROM documents)",
         "r AS (SELECT *, CASE WHEN coalesce(language, 'unknown') NOT IN ('en', 'unknown') AND length(cleaned) % 7 <> 0 "
         f"THEN {SM.strip_ws(chr(39) + 'en: ' + chr(39) + ' || cleaned')} ELSE cleaned END AS translated_text FROM d)"],
        "SELECT doc_id, language, translated_text <> cleaned AS changed, sha256(translated_text) AS text_hash FROM r"),
    "train_language_profiles": SM.with_(_LM, "SELECT g, lang, round(w, 6) AS w FROM lm_w"),
    "score_languages": SM.with_(
        _LM + [f"src AS (SELECT doc_id AS id, lang, {SM.pdt(S.clean_text('text'))} AS dt FROM documents)"]
        + SM.lang_score_ctes("src", "det"),
        "SELECT s.id AS doc_id, s.lang, d.detected, d.n_grams FROM src s JOIN det d ON d.id = s.id"),
    "detect_language_request": SM.with_(
        _LM + [f"src0 AS (SELECT doc_id AS id, {SM.rdt('text')} AS dt0 FROM documents)",
               "src AS (SELECT id, CASE WHEN length(dt0) < 3 THEN NULL ELSE dt0 END AS dt FROM src0)"]
        + SM.lang_score_ctes("src", "det"),
        "SELECT id AS doc_id, coalesce(detected, 'en') AS language FROM det"),
    "detect_language_pipeline": SM.with_(
        _LM + [f"c AS (SELECT doc_id AS id, {S.clean_text('text')} AS cleaned FROM documents)",
               f"src0 AS (SELECT id, cleaned, {SM.pdt('cleaned')} AS dt0 FROM c)",
               "src AS (SELECT id, CASE WHEN length(trim(cleaned, ' ')) < 10 OR length(dt0) < 5 THEN NULL ELSE dt0 END AS dt "
               "FROM src0)"]
        + SM.lang_score_ctes("src", "det"),
        f"SELECT id AS doc_id, CASE WHEN detected IS NULL THEN 'unknown' ELSE {SM.lang_code_map('detected')} END AS language "
        "FROM det"),
    "map_language_code": f"SELECT doc_id, code, {SM.lang_code_map('code')} AS mapped FROM {_CODE_SQL} t",
    "supported_language_filter": (
        f"SELECT doc_id, code, {_supported_sql('code')} AS is_supported FROM "
        f"(SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN 'xx' ELSE code END AS code FROM {_CODE_SQL} t0) t"),
    "route_for_translation": (
        "SELECT doc_id, language, enabled, enabled AND coalesce(language, 'unknown') NOT IN ('en', 'unknown') AS route "
        "FROM (SELECT doc_id, CASE WHEN n_chars < 10 THEN 'unknown' ELSE lang END AS language, doc_id % 2 = 0 AS enabled "
        "FROM documents) t"),
    "apply_translations": SM.with_(
        [f"tr0 AS (SELECT sha256({S.clean_text('text')}) AS src_key, lang AS src_lang, doc_id, "
         f"CASE WHEN doc_id % 3 = 0 THEN 'en: ' || {S.clean_text('text')} ELSE '  ' END AS translated "
         "FROM documents WHERE lang <> 'en' AND doc_id % 3 <> 2)",
         "tr AS (SELECT src_key, src_lang, arg_min(translated, doc_id) AS translated FROM tr0 GROUP BY src_key, src_lang)",
         f"d AS (SELECT doc_id, lang AS language, {S.clean_text('text')} AS cleaned FROM documents)",
         "r AS (SELECT d.doc_id, d.language, d.cleaned, "
         "CASE WHEN coalesce(d.language, 'unknown') NOT IN ('en', 'unknown') "
         f"THEN coalesce(nullif({SM.strip_ws('tr.translated')}, ''), d.cleaned) ELSE d.cleaned END AS translated_text "
         "FROM d LEFT JOIN tr ON tr.src_key = sha256(d.cleaned) AND tr.src_lang = d.language)"],
        "SELECT doc_id, language, translated_text <> cleaned AS changed, sha256(translated_text) AS text_hash FROM r"),
}
