"""The given parquet tables and the stand-in tables Spark derives from them (FIXTURES.md §3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Tables whose rows carry long texts: per-row work on them is CPU-heavy.
TEXT_TABLES = ("documents", "pages", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES:
        from verba.session import spread
        return spread(df)
    return df


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as classification history; anonymous (null user) where event_id % 7 = 0."""
    ev = load(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).cast("long").alias("user_id"),
        F.col("props").alias("text"),
        F.col("event_type").alias("prediction"),
        (F.col("value") / 500).alias("confidence"),
        F.col("ts").alias("created_at"),
        F.col("value"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = load(spark, sf_dir, "customer")
    return cu.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("full_name"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as CSV jobs: O/F/P -> processing/completed/failed."""
    o = load(spark, sf_dir, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "O", "processing")
        .when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("failed")
    )
    ended = F.when(
        F.col("o_orderstatus") != "O",
        F.timestamp_add("SECOND", F.col("o_orderkey") % 4000, F.col("o_orderdate")),
    )
    total = (F.col("o_totalprice") / 1000).cast("long") + 1
    processed = (F.when(F.col("o_orderstatus") == "F", total)
                 .when(F.col("o_orderstatus") == "P", (total / 2).cast("long"))
                 .otherwise((total / 3).cast("long")))
    sizes = F.array(*[F.lit(x) for x in (1, 4, 8, 16, 64, 128, 256)])
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.col("o_orderpriority").alias("queue"),
        F.col("o_orderdate").alias("started_at"),
        ended.alias("ended_at"),
        F.col("o_totalprice"),
        F.element_at(sizes, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("batch_size"),
        total.alias("total_rows"),
        processed.alias("processed_rows"),
        (processed * 100.0 / total).alias("progress_pct"),
    )


def queue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as queued jobs: F finished; O even queued / odd started; P even failed / odd scheduled."""
    o = load(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    status = (
        F.when(F.col("o_orderstatus") == "F", "finished")
        .when((F.col("o_orderstatus") == "O") & even, "queued")
        .when(F.col("o_orderstatus") == "O", "started")
        .when(even, "failed")
        .otherwise("scheduled")
    )
    ended = F.when(
        F.col("o_orderstatus") != "O",
        F.timestamp_add("SECOND", F.col("o_orderkey") % 4000, F.col("o_orderdate")),
    )
    total = (F.col("o_totalprice") / 1000).cast("long") + 1
    done = F.when(F.col("o_orderstatus") == "F", total).when(status == "started", (total / 3).cast("long")).when(status == "failed", (total / 2).cast("long"))
    word = F.when(status == "finished", "completed").when(status == "started", "processing").otherwise("failed")
    progress = F.when(done.isNotNull(), F.struct(word.alias("status"), done.alias("processed"), total.alias("total"),
                                                 (done * 100 / total).cast("int").alias("percentage")))
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("queue"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("started_at"),
        ended.alias("ended_at"),
        F.col("o_totalprice"),
        F.format_string("total=%.2f", F.col("o_totalprice")).alias("result"),
        F.lit(None).cast("string").alias("failure_info"),
        progress.alias("progress"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as CSV result rows; row_index numbers a job's rows by all columns."""
    from verba.sources.io import index_within

    order_cols = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", *order_cols)
    return _result_columns(index_within(li, "l_orderkey", order_cols), F.col("row_index"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results() without row_index, for what needs no numbering."""
    return _result_columns(load(spark, sf_dir, "lineitem"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as the event log of batch jobs: a start with the number of texts, a text per line
    (failed where its result has an error), an end unless the job is processing; every tenth job has a text
    after its end, every sixth one before its start, both of which are impossible."""
    rows = result_rows(spark, sf_dir)
    j = jobs(spark, sf_dir)
    n = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("long").alias("total")
    first, last = F.timestamp_add("YEAR", F.lit(-50), F.col("started_at")), F.timestamp_add("YEAR", F.lit(50), F.col("started_at"))
    start = j.join(n, "job_id", "left").select("job_id", first.alias("ts"), F.lit(1).alias("seq"), F.lit("start").alias("event"),
                                               (F.coalesce("n", F.lit(0)) + F.col("job_id") % 2).alias("total"))
    texts = rows.select("job_id", F.col("created_at").alias("ts"), (F.col("l_linenumber") * 2 + F.col("error_message").isNotNull().cast("int")).alias("seq"),
                        F.when(F.col("error_message").isNotNull(), F.lit("failed_text")).otherwise(F.lit("ok")).alias("event"), none)
    end = j.where("status <> 'processing'").select("job_id", last.alias("ts"), F.lit(1).alias("seq"),
                                                   F.when(F.col("status") == "completed", F.lit("complete")).otherwise(F.lit("fail")).alias("event"), none)
    late = j.where("status <> 'processing' AND job_id % 10 = 0").select("job_id", last.alias("ts"), F.lit(2).alias("seq"), F.lit("ok").alias("event"), none)
    early = j.where("job_id % 6 = 0").select("job_id", first.alias("ts"), F.lit(0).alias("seq"), F.lit("ok").alias("event"), none)
    return start.unionByName(texts).unionByName(end).unionByName(late).unionByName(early)


def _result_columns(li: DataFrame, *more) -> DataFrame:
    return li.select(
        F.col("l_orderkey").alias("job_id"),
        *more,
        F.col("l_linenumber"),
        F.col("l_returnflag").alias("prediction"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_tax").alias("processing_time"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), F.lit("model failed"))
        .alias("error_message"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_linestatus"),
        F.col("l_quantity"),
    )


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents plus their cleaned text (TXT9), written once to the shared checkpoint folder so that
    language profiles, the translation table, model corpora and classification all reuse one
    regex pass over the texts."""
    from verba.functions.text import clean_text
    from verba.session import materialize

    d = load(spark, sf_dir, "documents")
    return materialize(d.select("doc_id", "text", "lang", clean_text("text").alias("cleaned")))


def translations(spark: SparkSession, sf_dir: str, cleaned_docs: DataFrame | None = None) -> DataFrame:
    """Stand-in for a caller's translations (FIXTURES §3), keyed by (sha256 of cleaned text, language): doc_id % 3 = 0
    -> 'en: ' + the text; 1 -> blank; 2 -> absent. One row per key. Queries pass it; no operator reads it."""
    from verba.functions.text import clean_text
    from verba.operators.language import map_language_code, text_key
    from verba.session import materialize

    src = cleaned_docs if cleaned_docs is not None else load(spark, sf_dir, "documents")
    d = src.filter((F.col("lang") != "en") & (F.col("doc_id") % 3 != 2))
    cleaned = F.col("cleaned") if cleaned_docs is not None else clean_text("text")
    tr = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("en: "), cleaned)).otherwise(F.lit("  "))
    rows = d.select(text_key(cleaned).alias("src_key"), map_language_code("lang").alias("src_lang"), "doc_id", tr.alias("translated"))
    return materialize(rows.groupBy("src_key", "src_lang").agg(F.min_by("translated", "doc_id").alias("translated")))
