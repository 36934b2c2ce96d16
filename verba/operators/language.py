"""Language identification and translation.

The per-row detector library is re-aimed as a trained Spark job: character
trigram counts per language that batches add to (LNG1), looked up for whole
batches of texts (LNG2). The request and pipeline policies around the detector
are kept as column rules (LNG3, LNG4). Translations come from the caller: a table
(LNG8 below) or a translator with a memory (``memory.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.functions import text as T
from verba.operators.counts import count_features
from verba.operators.models import CountModel, models_from_counts, with_sums
from verba.session import bounded_broadcast
from verba.sources.tables import load

# ---- fixed values ----
SUPPORTED_LANGUAGES = [
    "en", "vi", "fr", "de", "es", "it", "pt", "ru", "ja", "ko",
    "zh-cn", "zh-tw", "ar", "hi", "th", "tr", "pl", "nl", "sv",
]
LANGUAGE_CODE_MAP = {
    "vi": "vi", "en": "en", "zh-cn": "zh", "ja": "ja", "ko": "ko", "th": "th",
    "fr": "fr", "de": "de", "es": "es", "it": "it", "ru": "ru", "ar": "ar",
}
UNKNOWN = "unknown"
REQUEST_DEFAULT = "en"
NO_TRANSLATION = ("en", UNKNOWN)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def padded(text) -> Column:
    """The text whose trigrams are the detector's features: lower-cased, with a space at both ends."""
    return F.concat(F.lit(" "), F.lower(_c(text)), F.lit(" "))


def pipeline_detector_text(cleaned) -> Column:
    """LNG4's clean-up of already-cleaned text: non-word -> space, drop digits, collapse."""
    c = F.regexp_replace(_c(cleaned), T.NOT_WORD_NOT_SPACE, " ")
    c = F.regexp_replace(c, T.DIGITS, "")
    return T.collapse_whitespace(c)


def request_detector_text(raw) -> Column:
    """LNG3's clean-up of raw text: collapse, strip URLs, drop mentions/hashtags, trim."""
    c = T.collapse_whitespace(_c(raw))
    c = T.strip_urls(c)
    c = T.drop_mentions_hashtags(c)
    return T.strip_ws(c)


def profile_features(detector_text) -> list:
    """What is counted of a text: the character trigrams of the lower-cased, space-padded text."""
    return [("gram", padded(detector_text))]


def language_counts(corpus: DataFrame, text_col: str = "text", lang_col: str = "lang", cleaned_col: str | None = None) -> DataFrame:
    """LNG1: trigram counts per language, as a long table (``counts.py``) to which other batches' counts can be
    added. ``cleaned_col`` names an already-cleaned text column (skips TXT9)."""
    cleaned = F.col(cleaned_col) if cleaned_col else T.clean_text(F.col(text_col))
    src = corpus.select(F.col(lang_col).alias("lang"), pipeline_detector_text(cleaned).alias("t"))
    return count_features(src, "lang", profile_features("t"))


def profiles_from_counts(counts: DataFrame) -> CountModel:
    return models_from_counts(counts, [("language", "gram")])[0]


def train_language_profiles(corpus: DataFrame, text_col: str = "text", lang_col: str = "lang",
                            cleaned_col: str | None = None) -> CountModel:
    """LNG1: per-language trigram log weights with add-one smoothing; any number of languages."""
    return profiles_from_counts(language_counts(corpus, text_col, lang_col, cleaned_col))


def language_profiles(spark: SparkSession, sf_dir: str, cleaned_docs: DataFrame | None = None) -> CountModel:
    """Profiles from the labelled corpus, all documents."""
    docs = cleaned_docs if cleaned_docs is not None else load(spark, sf_dir, "documents")
    return train_language_profiles(docs, cleaned_col="cleaned" if cleaned_docs is not None else None)


def with_language(docs: DataFrame, model: CountModel, detector_text) -> DataFrame:
    """LNG2: sum of gram log weights + prior per language; argmax, first language (sorted) wins a tie. Adds
    ``n_grams``, ``lang_scores`` and ``detected`` (null when the text has no grams in the profiles); one
    row per row, and no shuffle unless the profiles are too large to go along."""
    out = with_sums(docs, [model], padded(detector_text))
    scores = F.array(*[F.lit(lp) + F.col("_s0.s")[k] for k, lp in enumerate(model.log_priors)])
    classes = F.array(*[F.lit(c) for c in model.classes])
    out = out.withColumn("n_grams", F.col("_s0.n")).withColumn("lang_scores", scores).drop("_s0")
    best = F.element_at(classes, SC.best_index("lang_scores")) if model.classes else F.lit(None).cast("string")
    return out.withColumn("detected", F.when(F.col("n_grams") > 0, best))


def score_languages(docs: DataFrame, model: CountModel, detector_text: str, keep: list) -> DataFrame:
    """LNG2 with the columns ``keep``."""
    return with_language(docs, model, F.col(detector_text)).select(*keep, "n_grams", "lang_scores", "detected")


def map_language_code(col) -> Column:
    """LNG5: 12-entry map; unknown codes pass through."""
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODE_MAP.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(col)), _c(col))


def detect_language_pipeline(docs: DataFrame, model: CountModel, cleaned_col: str, out: str = "language") -> DataFrame:
    """LNG4 on cleaned text: trimmed < 10 -> unknown; detector text < 5 -> unknown; no grams -> unknown; map
    code. ``docs`` with the column ``out``."""
    d = docs.withColumn("_dt", pipeline_detector_text(cleaned_col))
    short = (F.length(F.trim(F.col(cleaned_col))) < 10) | (F.length("_dt") < 5)
    scored = with_language(d, model, F.when(short, F.lit(None).cast("string")).otherwise(F.col("_dt")))
    lang = F.when(F.col("detected").isNull(), F.lit(UNKNOWN)).otherwise(map_language_code("detected"))
    return scored.withColumn(out, lang).drop("_dt", "n_grams", "lang_scores", "detected")


def detect_language_request(docs: DataFrame, model: CountModel, raw_col: str, out: str = "language") -> DataFrame:
    """LNG3 on raw text: under 3 characters after clean-up -> en; no grams -> en; codes unmapped. ``docs``
    with the column ``out``."""
    d = docs.withColumn("_dt", request_detector_text(raw_col))
    scored = with_language(d, model, F.when(F.length("_dt") < 3, F.lit(None).cast("string")).otherwise(F.col("_dt")))
    return scored.withColumn(out, F.coalesce(F.col("detected"), F.lit(REQUEST_DEFAULT))).drop("_dt", "n_grams", "lang_scores", "detected")


def supported_language_flag(col) -> Column:
    """LNG6"""
    return _c(col).isin(SUPPORTED_LANGUAGES)


def route_for_translation(lang_col, enable_translation=True) -> Column:
    """LNG7: translate iff enabled and the language is neither en nor unknown."""
    enabled = enable_translation if isinstance(enable_translation, Column) else F.lit(bool(enable_translation))
    return enabled & ~F.coalesce(_c(lang_col), F.lit(UNKNOWN)).isin(*NO_TRANSLATION)


def text_key(col) -> Column:
    return F.sha2(_c(col), 256)


def apply_translations(docs: DataFrame, translations: DataFrame, text_col: str, lang_col: str,
                       route: Column, out: str = "translated_text") -> DataFrame:
    """LNG8: routed rows take a non-blank translation; missing/blank keeps the original text.
    The translation table is broadcast only under a measured bound of its bytes."""
    rows, chars = translations.agg(F.count(F.lit(1)), F.sum(F.octet_length("translated"))).first()
    size = rows * 96 + (chars or 0)  # keys and whole texts
    tr = bounded_broadcast(translations.select("src_key", "src_lang", F.col("translated").alias("_tr")), size)
    d = docs.withColumn("_key", text_key(text_col)).withColumn("_route", route)
    cond = (F.col("_key") == F.col("src_key")) & (F.col(lang_col) == F.col("src_lang")) & F.col("_route")
    j = d.join(tr, cond, "left")
    good = F.nullif(T.strip_ws(F.col("_tr")), F.lit(""))
    res = F.when(F.col("_route"), F.coalesce(good, F.col(text_col))).otherwise(F.col(text_col))
    return j.withColumn(out, res).drop("_key", "_route", "src_key", "src_lang", "_tr")
