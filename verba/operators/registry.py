"""Tasks, models and labels of the service, and which models a request selects (MDL1, MDL2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: the reference's model registry and label sets ----
# (task, model key, display name, our stand-in kind)
REGISTRY = [
    ("sentiment", "twitter-roberta", "Roberta-base", "word"),
    ("sentiment", "twitter-roberta-xml", "XML-Roberta-base-multilingual", "char"),
    ("spam", "roberta-sms", "Roberta-base", "word"),
    ("spam", "distilbert-sms", "Distilbert-base", "char"),
    ("topic", "bart-mnli", "Bart-large", "cosine"),
    ("topic", "deberta-nli", "Deberta-small", "distance"),
]
TOPIC_LABELS = [
    "technology", "sports", "politics", "entertainment", "business",
    "health", "education", "travel", "food", "science",
]
# Raw model classes per text task, and the label each is reported as.
TASK_CLASSES = {
    "sentiment": ["Negative", "Positive"],
    "spam": ["LABEL_0", "LABEL_1"],
}
TASKS = ("sentiment", "spam", "topic")
# What the service says of a task, and its languages (fixed values).
TASK_INFO = {
    "sentiment": ("Sentiment Analysis (Positive/Negative/Neutral)", ["en", "multilingual", "auto"]),
    "spam": ("Spam Detection (Spam/Not Spam)", ["en", "auto"]),
    "topic": ("Topic Classification", ["en", "auto"]),
}
ONE_UNKNOWN = "Model '%s' not available for type '%s'"
NONE_KNOWN = "None of the specified models are available for type '%s'"


def output_label(task: str, raw: str) -> str:
    """Sentiment labels are lower-cased; spam maps LABEL_1 -> spam, anything else -> not_spam."""
    if task == "spam":
        return "spam" if raw == "LABEL_1" else "not_spam"
    if task == "sentiment":
        return raw.lower()
    return raw


def task_description(task) -> Column:
    c = F.col(task)
    known = F.coalesce(*[F.when(c == t, F.lit(d)) for t, (d, _) in TASK_INFO.items()])
    return F.coalesce(known, F.concat(F.initcap(c), F.lit(" Classification")))


def task_languages(task) -> Column:
    own = F.coalesce(*[F.when(F.col(task) == t, F.array(*map(F.lit, x))) for t, (_, x) in TASK_INFO.items()])
    return F.coalesce(own, F.array(F.lit("en"), F.lit("auto")))


def registry_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, k, d, kind, i) for i, (t, k, d, kind) in enumerate(REGISTRY)],
        "task string, model_key string, display_name string, kind string, reg_pos int",
    )


def available_models(registry: DataFrame, loaded_tasks: DataFrame) -> DataFrame:
    """MDL1: the models of each loaded task (a task with training rows), with what the service says of it."""
    per_task = registry.groupBy("task").agg(F.count(F.lit(1)).alias("models_in_task"))
    reg = registry.join(F.broadcast(loaded_tasks.select("task").distinct()), "task", "left_semi")  # three tasks at most
    return reg.join(F.broadcast(per_task), "task").select(
        "task", "model_key", "display_name", "models_in_task", task_description("task").alias("description"),
        F.array_join(task_languages("task"), ",").alias("languages"))


def resolve_model_selection(requests: DataFrame, registry: DataFrame, key: str = "conv_id") -> DataFrame:
    """MDL2: (key, task, sel_str | sel_list) -> (key, pos, model_key, error), a row per selected model or error.

    ``all``, or neither string nor list, selects every model of the task; a string with a comma is a list, not
    trimmed; one unknown model is an error, a list keeps its known models and is an error if none is."""
    reg = F.broadcast(registry.select("task", "model_key", "reg_pos"))
    text, listed = F.col("sel_str"), F.col("sel_list")
    is_all = listed.isNull() & F.coalesce(text == "all", F.lit(True))
    many = listed.isNotNull() | F.coalesce(text.contains(","), F.lit(False))
    keys = F.when(listed.isNotNull(), listed).when(many, F.split(text, ",", -1)).otherwise(F.array(text))
    req = requests.select(key, "task", "sel_str", is_all.alias("is_all"), many.alias("many"), keys.alias("keys"))
    whole = req.filter("is_all").join(reg, "task").select(key, F.col("reg_pos").alias("pos"), "model_key")
    named = req.filter(~F.col("is_all"))
    known = named.select(key, "task", F.posexplode("keys").alias("pos", "model_key")).join(reg, ["task", "model_key"], "left_semi") \
        .select(key, "pos", "model_key")
    failed = named.join(known.select(key).distinct(), key, "left_anti")
    msg = F.when(F.col("many"), F.format_string(NONE_KNOWN, "task")).otherwise(F.format_string(ONE_UNKNOWN, "sel_str", "task"))
    errors = failed.select(key, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("model_key"), msg.alias("error"))
    return whole.unionByName(known).withColumn("error", F.lit(None).cast("string")).unionByName(errors)


def resolve_selection(task: str, selection, extra: list[str] = ()) -> list[str]:
    """The same rule for the one selection of a job, whose keys the driver needs to load models; ``extra`` are
    keys beside the registry's. ValueError where resolve_model_selection() has an error row."""
    keys = [k for t, k, _d, _kind in REGISTRY if t == task] + list(extra)
    if selection is None or selection == "all":
        return keys
    many = not isinstance(selection, str) or "," in selection
    asked = (selection.split(",") if isinstance(selection, str) else list(selection)) if many else [selection]
    chosen = [k for k in asked if k in keys]
    if not chosen:
        raise ValueError(NONE_KNOWN % task if many else ONE_UNKNOWN % (selection, task))
    return chosen
