"""Reporting rules as column expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- fixed values ----
BAND_HIGH, BAND_MEDIUM = 0.8, 0.6
MODE_LOW, MODE_HIGH = 0.8, 1.2
N_COLOURS = 10
SENTIMENT_SYMBOLS = {"positive": "😊", "negative": "😞", "neutral": "😐"}
SENTIMENT_OTHER = "🤔"
HISTORY_SENTIMENT_OTHER = "😐"
SPAM_SYMBOL, HAM_SYMBOL, TOPIC_SYMBOL = "🚫", "✅", "📝"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def confidence_band(conf) -> Column:
    """RPT1"""
    c = _c(conf)
    return F.when(c >= BAND_HIGH, "high").when(c >= BAND_MEDIUM, "medium").otherwise("low")


def prediction_symbol(task, prediction, history_view: bool = False) -> Column:
    """RPT4: the result view matches labels exactly; the history view tests substrings.
    Our rule for spam in history is equality (quirk 13), so both views agree on not_spam."""
    t, p = _c(task), F.lower(_c(prediction))
    if history_view:
        senti = (F.when(p.contains("positive"), SENTIMENT_SYMBOLS["positive"])
                 .when(p.contains("negative"), SENTIMENT_SYMBOLS["negative"]).otherwise(HISTORY_SENTIMENT_OTHER))
    else:
        senti = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SENTIMENT_SYMBOLS.items() for x in kv]), p),
                           F.lit(SENTIMENT_OTHER))
    spam = F.when(p == "spam", SPAM_SYMBOL).otherwise(HAM_SYMBOL)
    return F.when(t == "sentiment", senti).when(t == "spam", spam).otherwise(TOPIC_SYMBOL)


def temperature_mode(t) -> Column:
    """RPT8: < 0.8 high confidence, 0.8..1.2 balanced, > 1.2 exploratory."""
    c = _c(t)
    return F.when(c < MODE_LOW, "high_confidence").when(c <= MODE_HIGH, "balanced").otherwise("exploratory")


def ranked_scores(scores_long: DataFrame, id_cols: list) -> DataFrame:
    """RPT2: per text, labels best first with percent (two decimals); the first is BEST.
    The window holds one text's labels (bounded by the label set)."""
    w = Window.partitionBy(*id_cols).orderBy(F.desc("score"), "label")
    r = scores_long.withColumn("rank", F.row_number().over(w))
    return r.select(*id_cols, "rank", "label", F.round(F.col("score") * 100, 2).alias("percent"),
                    (F.col("rank") == 1).alias("is_best"))


def chart_series(scores: Column, labels: list) -> Column:
    """RPT3 as an array of (label, percent to one decimal, colour index = position mod 10)."""
    lab = F.array(*[F.lit(x) for x in labels])
    return F.transform(scores, lambda s, i: F.struct(
        F.element_at(lab, i + 1).alias("label"), F.round(s * 100, 1).alias("percent"),
        F.pmod(i, F.lit(N_COLOURS)).alias("colour")))


def model_display_names(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """RPT5: key -> display name, the key itself when unknown (registry: fixed size, broadcast)."""
    reg = F.broadcast(registry.select("task", "model_key", "display_name"))
    j = keys.join(reg, ["task", "model_key"], "left")
    return j.withColumn("display_name", F.coalesce("display_name", "model_key"))


def selection_summary(selected: DataFrame, registry: DataFrame) -> DataFrame:
    """RPT9: no choice -> all models; one -> single with its display name, or its key if that is unknown; all ->
    ensemble of n; else k of n. A task without models has n = 0."""
    per_req = selected.groupBy("request_id", "task").agg(
        F.count("model_key").alias("k"), F.min("model_key").alias("only_key"))
    totals = registry.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    j = per_req.join(F.broadcast(totals), "task", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).join(
        F.broadcast(registry.select("task", F.col("model_key").alias("only_key"), "display_name")),
        ["task", "only_key"], "left")
    text = (F.when(F.col("k") == 0, F.lit("No model selected (will use all models)"))
            .when(F.col("k") == 1, F.concat(F.lit("Single model: "), F.coalesce("display_name", "only_key")))
            .when(F.col("k") == F.col("n"), F.format_string("Ensemble: All %d models combined", "n"))
            .otherwise(F.format_string("Ensemble: %d of %d models combined", "k", "n")))
    return j.select("request_id", "task", "k", "n", text.alias("summary"))
