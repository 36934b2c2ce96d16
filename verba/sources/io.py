"""Sources and sinks.

Scratch output goes under the session's shared checkpoint folder (never a
machine-local temp dir on a cluster). Writes are idempotent: a retried job
overwrites exactly the partitions it owns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verba.session import ensure_checkpoint_dir, partitions

# The strings that a default pandas CSV read takes for missing (fixed values).
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
              "NaN", "None", "n/a", "nan", "null")


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/verba-io/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_csv_texts(spark: SparkSession, path: str, schema, text_column: str = "text",
                   glob: str | None = "*.csv", corrupt_column: str = "_corrupt_record", multi_line: bool = False) -> DataFrame:
    """SRC1/SRC3: header, quoted commas and doubled quotes; explicit schema; only names ending in .csv
    (case-sensitive); pandas-style NA strings become nulls. A malformed line does not stop the read: with
    ``corrupt_column`` in the schema it lands there (PERMISSIVE). ``multi_line``: cells may hold newlines, for
    which each file is read by one task; without, large files are split."""
    reader = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
              .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", corrupt_column))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.csv(path)
    c = F.col(text_column)
    return df.withColumn(text_column, F.when(c.isin(*NA_STRINGS), F.lit(None)).otherwise(c))


def read_request_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: JSON requests carrying a list of texts -> one row per text with its position."""
    schema = "request_id long, texts array<string>"
    return spark.read.schema(schema).json(path).select("request_id", F.posexplode("texts").alias("pos", "text"))


def assign_row_index(df: DataFrame, order_cols: list, n_partitions: int | None = None) -> DataFrame:
    """SRC4: row_index 0..n-1 in order, without a global single-partition window: range-partition,
    number rows inside each partition, add per-partition offsets (one row per partition, broadcast).
    The partitioned rows are written once: counts and rows must come from the same range bounds, which
    Spark samples anew whenever the frame is computed again."""
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    r = r.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = scratch_path(spark, "row-index")
    r.write.parquet(path)
    r = spark.read.schema(r.schema).parquet(path)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = r.join(F.broadcast(offs), "_pid")
    return out.withColumn("row_index", F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off")


def index_within(df: DataFrame, key: str, order_cols: list) -> DataFrame:
    """row_index 0.. within each ``key``, in order; rows without a key are left out. Rows are dealt to range
    partitions by key and order and numbered where they lie, in one pass. Only the first and the last key of a
    partition can span partitions, so a key with a third of all rows is many tasks' work, and what it has
    in earlier partitions is one row a partition. The numbered rows are written once, as by assign_row_index()."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def place(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import pandas as pd

        last, done = None, 0  # the key that the part before ended with, and its rows so far
        for k in keys:
            v = k.to_numpy()
            begins = np.ones(len(v), dtype=bool)
            begins[1:] = v[1:] != v[:-1]
            at = np.flatnonzero(begins)
            sizes = np.diff(np.append(at, len(v)))
            out = np.arange(len(v)) - np.repeat(at, sizes)
            if len(v):
                if last is not None and v[0] == last:
                    out[: sizes[0]] += done
                last, done = v[-1], int(out[-1]) + 1
            yield pd.Series(out)

    spark, path = df.sparkSession, scratch_path(df.sparkSession, "row-index")
    r = df.where(F.col(key).isNotNull()).repartitionByRange(partitions(df), key, *order_cols).sortWithinPartitions(key, *order_cols)
    r = r.select("*", F.spark_partition_id().alias("_pid"), place.asNondeterministic()(key).alias("_at"))
    r.write.parquet(path)
    r = spark.read.schema(r.schema).parquet(path)
    ends = r.groupBy("_pid").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.max_by("_at", F.struct(key, "_at")).alias("_n"))
    before = Window.orderBy("_pid")  # over one row per partition
    so_far = Window.partitionBy("_hi").orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_sum", F.sum(F.col("_n") + 1).over(so_far))
    goes_on = F.lag("_hi").over(before) == F.col("_lo")
    carry = ends.select("_pid", "_lo", F.when(goes_on, F.lag("_sum").over(before)).otherwise(F.lit(0)).alias("_off"))
    out = r.join(F.broadcast(carry), "_pid")
    return out.select(key, *[c for c in df.columns if c != key],
                      (F.col("_at") + F.when(F.col(key) == F.col("_lo"), F.col("_off")).otherwise(F.lit(0))).alias("row_index"))


def write_results(df: DataFrame, path: str, partition_cols: list) -> None:
    """SNK1: parquet, dynamic partition overwrite as a writer option. ``partition_cols`` must name the
    batch, besides the job or its bucket: a retried batch then replaces its own rows and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path)


REPORT_HEADERS = ["Row Index", "Text", "Prediction", "Confidence", "Language", "Processing Time (ms)", "Error"]


def csv_report(results: DataFrame, *more: str) -> DataFrame:
    """SNK2 projection: confidence x100 with two decimals and '%', time x1000 without decimals,
    null error -> empty."""
    return results.select(
        F.col("row_index").cast("string").alias(REPORT_HEADERS[0]),
        F.col("text").alias(REPORT_HEADERS[1]),
        F.col("prediction").alias(REPORT_HEADERS[2]),
        F.when(F.col("confidence").isNotNull(), F.format_string("%.2f%%", F.col("confidence") * 100)).alias(REPORT_HEADERS[3]),
        F.col("language").alias(REPORT_HEADERS[4]),
        F.when(F.col("processing_time").isNotNull(), F.format_string("%.0f", F.col("processing_time") * 1000)).alias(REPORT_HEADERS[5]),
        F.coalesce(F.col("error_message"), F.lit("")).alias(REPORT_HEADERS[6]),
        *more,
    )


def report_line() -> Column:
    """A line of the report: the text quoted, with doubled quotes; the other cells as they are."""
    h = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in REPORT_HEADERS]
    h[1] = F.concat(F.lit('"'), F.replace(h[1], F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *h)


def write_csv_report(results: DataFrame, path: str, order: list[str]) -> None:
    """SNK2: the report as files that, put together by name, are one CSV: one header, then the rows by
    ``order``. Files are range partitions; the header is a row that comes before all others, so no file has one
    of its own. Every line ends with a newline, the last one too. Rows are dealt before they are formatted: the bounds
    are found by a pass of its own, which formats nothing."""
    spark = results.sparkSession
    cells = ["row_index", "text", "prediction", "confidence", "language", "processing_time", "error_message"]
    rows = results.select(F.lit(1).alias("_part"), F.struct(*[results[c] for c in order]).alias("_o"), *[results[c] for c in cells])
    header = spark.range(1).select(F.lit(0).alias("_part"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:]])
    dealt = rows.unionByName(header).repartitionByRange(partitions(rows), "_part", "_o").sortWithinPartitions("_part", "_o")
    line = F.when(F.col("_part") == 0, F.lit(",".join(REPORT_HEADERS))).otherwise(report_line())
    csv_report(dealt, "_part").select(line.alias("value")).write.mode("overwrite").text(path)


def read_csv_report(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a report that write_csv_report() wrote."""
    schema = ", ".join(f"`{c}` string" for c in REPORT_HEADERS)
    back = spark.read.schema(schema).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return back.where(F.coalesce(F.col(f"`{REPORT_HEADERS[0]}`"), F.lit("")) != REPORT_HEADERS[0]).fillna("", subset=["Error"])


def export_json(results: DataFrame, path: str) -> None:
    """SNK3: one JSON object per result row."""
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.mode("overwrite").text(path)


def text_hash(col) -> Column:
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)
