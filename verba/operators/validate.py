"""Validation: one-pass table profile, first-failure-wins table check,
row rules as an array of failed rule names, and the valid/invalid split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.functions import text as T
from verba.operators.jobs import ALLOWED_BATCH_SIZES

# ---- fixed values ----
MAX_TEXT_CHARS = 10000
MAX_ROWS = 10000
MIN_TEXT, MIN_UI_TEXT = 1, 10
MAX_TEXTS_PER_REQUEST = 100
TASKS = ("sentiment", "spam", "topic")
SAMPLE_TEXTS = 3


def profile_text_table(df: DataFrame, text_column: str, order: str = "row_index") -> DataFrame:
    """VAL1: one aggregation for row count, null count and max length, and an ordered limit for the first three
    texts by ``order``; no row is moved for either."""
    cols = F.lit(",".join(x for x in df.columns if x != "row_index")).alias("columns")
    if text_column not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            "row_count", F.lit(0).cast("long").alias("null_count"), F.lit(None).cast("int").alias("max_length"),
            cols, F.array().cast("array<string>").alias("sample_texts"), F.lit(False).alias("has_column"))
    c = F.col(text_column)
    first = df.select(F.struct(F.col(order).alias("i"), c.alias("t")).alias("x")).orderBy("x.i").limit(SAMPLE_TEXTS)
    texts = first.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]).alias("t"))
    g = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(c.isNull()).alias("null_count"), F.max(F.length(c)).alias("max_length"))
    return g.select("row_count", "null_count", "max_length", cols, texts.scalar().alias("sample_texts"), F.lit(True).alias("has_column"))


def validate_text_table(profile: DataFrame, text_column: str, max_rows: int | None = None) -> DataFrame:
    """VAL2: first failing check wins: empty, column missing, nulls, longest > 10000, rows > cap.
    The row cap is a parameter and off by default."""
    cols_list = F.concat(F.lit("['"), F.array_join(F.split("columns", ","), "', '"), F.lit("']"))
    checks = (
        F.when(F.col("row_count") == 0, F.lit("CSV file is empty"))
        .when(~F.col("has_column"), F.concat(F.lit(f"Column '{text_column}' not found. Available columns: "), cols_list))
        .when(F.col("null_count") > 0, F.format_string(f"Found %d empty values in '{text_column}' column", "null_count"))
        .when(F.col("max_length") > MAX_TEXT_CHARS,
              F.format_string("Text too long. Maximum length is 10,000 characters, found %d", "max_length"))
    )
    if max_rows is not None:
        checks = checks.when(F.col("row_count") > max_rows,
                             F.format_string(f"Too many rows. Maximum is {max_rows:,} rows, found %d", "row_count"))
    return profile.select(checks.isNull().alias("valid"), checks.alias("error"), "row_count")


def request_rule_failures(text: Column, task: Column, temperature: Column, batch_size: Column,
                          n_texts: Column) -> Column:
    """VAL3: names of the failed rules, in rule order (empty array: valid)."""
    n = F.length(text)
    rules = [
        ("text_length", text.isNull() | (n < MIN_TEXT) | (n > MAX_TEXT_CHARS)),
        ("model_type", ~F.coalesce(task.isin(*TASKS), F.lit(False))),
        ("temperature", ~F.coalesce((temperature >= SC.T_MIN) & (temperature <= SC.T_MAX), F.lit(False))),
        ("batch_size", ~F.coalesce(batch_size.isin(*ALLOWED_BATCH_SIZES), F.lit(False))),
        ("texts_per_request", ~F.coalesce((n_texts >= 1) & (n_texts <= MAX_TEXTS_PER_REQUEST), F.lit(False))),
    ]
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def split_valid_invalid(df: DataFrame, failures: str = "failed_rules"):
    """VAL4: good rows go on; bad rows carry an error and do not stop the rest."""
    ok = F.size(F.col(failures)) == 0
    valid = df.filter(ok).withColumn("status", F.lit("valid")).withColumn("error", F.lit(None).cast("string"))
    invalid = df.filter(~ok).withColumn("status", F.lit("invalid")).withColumn(
        "error", F.concat(F.lit("invalid: "), F.array_join(failures, ",")))
    return valid, invalid


def text_length_flags(text) -> list:
    """VAL5: too_short = trimmed length 1..9; too_long = raw length > 10000."""
    c = F.col(text) if isinstance(text, str) else text
    tl = F.length(T.strip_ws(c))
    return [((tl >= 1) & (tl < MIN_UI_TEXT)).alias("too_short"), (F.length(c) > MAX_TEXT_CHARS).alias("too_long")]
