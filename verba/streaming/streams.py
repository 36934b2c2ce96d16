"""Structured Streaming.

Every sink is a ``foreachBatch`` that a replayed epoch (restart after a lost
executor or driver) can't double: it overwrites one directory per epoch, or commits
the epoch as a batch of a table (``commits.py``); the checkpoint lives in the shared
checkpoint folder. Tests and the registered queries drive the streams with
``trigger(availableNow=True)`` so they finish.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.session import materialize
from verba.sources.commits import CommittedTable
from verba.sources.io import scratch_path


def epoch_sink(out_dir: str, transform=None):
    """foreachBatch body: (optionally transform) and overwrite out_dir/epoch=<id>."""
    def run(batch: DataFrame, epoch_id: int):
        res = transform(batch) if transform else batch
        res.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")
    return run


def run_available(stream: DataFrame, sink, checkpoint: str, output_mode: str = "append"):
    q = (stream.writeStream.foreachBatch(sink).outputMode(output_mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_epochs(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir)


def split_into_files(df: DataFrame, path: str, n_files: int) -> None:
    """Land a table as several files."""
    df.repartition(n_files).write.mode("overwrite").parquet(path)


def stream_classify(spark: SparkSession, sf_dir: str, docs: DataFrame, task: str = "spam",
                    max_files: int = 2, n_files: int = 4, translations: DataFrame | None = None) -> DataFrame:
    """STR1: texts arriving as files get the same labels as the batch path; models and language profiles are
    trained once and stay static, as do the caller's ``translations`` (none: texts stay as they are)."""
    from verba.operators import language as L
    from verba.operators.registry import resolve_selection
    from verba.plans import classify as C

    src, out, ckpt = scratch_path(spark, "s1-in"), scratch_path(spark, "s1-out"), scratch_path(spark, "s1-ckpt")
    split_into_files(docs, src, n_files)
    models = C.load_models(spark, sf_dir, task, resolve_selection(task, "all"))
    lang_model = L.language_profiles(spark, sf_dir)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max_files).parquet(src)

    def classify(batch):
        r = C.classify_table(spark, sf_dir, batch, task=task, models=models, lang_model=lang_model,
                             translations=translations)
        return r.select("doc_id", "prediction", "confidence", "language", "is_ensemble",
                        F.array_join("models_used", ",").alias("models_used"))

    run_available(stream, epoch_sink(out, classify), ckpt)
    return read_epochs(spark, out).drop("epoch")


PROGRESS = "job_id long, processed_rows long, failed_rows long, total_rows long, state string"
STATE = "job_id long, processed_rows long, failed_rows long, total_rows long, ended boolean, last timestamp"


class ProgressSink:
    """foreachBatch body of STR2: the jobs' counts as a table of state, to which each epoch joins the sums of its
    rows, and the final rows of ended jobs, appended once. All jobs of an epoch are counted and merged by
    grouping and joins; no code runs per job. A state goes as soon as the watermark is past the last row
    of a job whose total was reached (until then rows beyond the total change nothing), or past the last row
    of any other job by ``silence``. An epoch reads the state of the epoch before it, so a replayed one
    does the same again and finds its batches committed."""

    def __init__(self, spark: SparkSession, path: str, totals: DataFrame, silence: str = "4000 days", delay: str = "1 day"):
        self.spark, self.totals, self.silence, self.delay = spark, totals.select("job_id", "total_rows"), silence, delay
        self.finals = CommittedTable(spark, f"{path}/finals", PROGRESS + ", epoch long")
        self.open = CommittedTable(spark, f"{path}/open", STATE)
        self.clock = CommittedTable(spark, f"{path}/clock", "high timestamp, epoch long")  # a row per epoch

    def _state(self, before: int | None = None) -> DataFrame:
        epochs = {int(f.rsplit("epoch=", 1)[1].split("+")[0]): f for f in self.open.folders()}
        last = max((e for e in epochs if before is None or e < before), default=None)
        return self.spark.createDataFrame([], STATE) if last is None else self.spark.read.schema(STATE).parquet(epochs[last])

    def _past(self, ts, high, silence: str | None = None):
        """Whether the watermark after ``high`` is past ``ts`` (and ``silence``); not where either is null."""
        end = ts + F.expr(f"INTERVAL {silence}") if silence else ts
        return F.coalesce(end <= F.timestamp_micros(F.lit(high).cast("long")) - F.expr(f"INTERVAL {self.delay}"), F.lit(False))

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        high = self.clock.read().where(F.col("epoch") < epoch).agg(F.max(F.unix_micros("high"))).first()[0]
        ts = F.col("created_at").cast("timestamp")
        rows = batch.where(~self._past(ts, high)).groupBy("job_id").agg(
            F.count(F.lit(1)).alias("n"), F.count("error_message").alias("failed"), F.max(ts).alias("ts"))
        new = rows.join(self.totals, "job_id", "left").groupBy("job_id").agg(
            F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.max("ts").alias("ts"), F.max("total_rows").alias("total")).alias("b")
        both = self._state(epoch).alias("a").join(new, F.col("a.job_id").eqNullSafe(F.col("b.job_id")), "full")
        was = F.coalesce("a.ended", F.lit(False))
        add = lambda kept, more: F.coalesce(F.col(kept), F.lit(0)) + F.when(was, F.lit(0)).otherwise(F.coalesce(F.col(more), F.lit(0)))
        jobs = both.select(
            F.coalesce("a.job_id", "b.job_id").alias("job_id"), add("a.processed_rows", "b.n").alias("processed_rows"),
            add("a.failed_rows", "b.failed").alias("failed_rows"), F.coalesce("b.total", "a.total_rows").alias("total_rows"),
            was.alias("was"), F.greatest("a.last", "b.ts").alias("last"))
        jobs = materialize(jobs.withColumn("ended", F.col("was") | F.coalesce(F.col("processed_rows") >= F.col("total_rows"), F.lit(False))))
        now = batch.agg(F.max(F.unix_micros(ts))).first()[0]
        high = max((h for h in (high, now) if h is not None), default=None)
        gone = F.when(F.col("ended"), self._past(F.col("last"), high)).otherwise(self._past(F.col("last"), high, self.silence))
        jobs = jobs.withColumn("gone", gone)
        state = F.when(F.col("ended"), F.lit("completed")).otherwise(F.lit("silent"))
        self.finals.append(jobs.where("ended AND NOT was OR gone AND NOT ended").select(
            "job_id", "processed_rows", "failed_rows", "total_rows", state.alias("state"), F.lit(epoch).cast("long").alias("epoch")), f"epoch={epoch}")
        self.open.append(jobs.where("NOT gone").select("job_id", "processed_rows", "failed_rows", "total_rows", "ended", "last"), f"epoch={epoch}")
        self.clock.append(self.spark.range(1).select(F.timestamp_micros(F.lit(high).cast("long")).alias("high"), F.lit(epoch).cast("long").alias("epoch")), f"epoch={epoch}")

    def read(self) -> DataFrame:
        """A row per job: as it was first completed, else all that was counted of it, in one stretch or several."""
        going = self._state().where("NOT ended").select("job_id", "processed_rows", "failed_rows", "total_rows", F.lit("processing").alias("state"),
                                                        F.lit(None).cast("long").alias("epoch"))
        rows = self.finals.read().unionByName(going)
        done = F.min(F.when(F.col("state") == "completed", F.struct("epoch", "processed_rows", "failed_rows")))
        g = rows.groupBy("job_id").agg(done.alias("d"), F.sum("processed_rows").alias("p"), F.sum("failed_rows").alias("f"),
                                       F.max("total_rows").alias("total_rows"), F.max(F.col("state") == "processing").alias("open"))
        state = F.when(F.col("d").isNotNull(), F.lit("completed")).when(F.col("open"), F.lit("processing")).otherwise(F.lit("silent"))
        return g.select("job_id", F.coalesce("d.processed_rows", "p").alias("processed_rows"), F.coalesce("d.failed_rows", "f").alias("failed_rows"),
                        "total_rows", state.alias("state"))


def stream_job_progress(spark: SparkSession, results: DataFrame, totals: DataFrame, deliveries: int = 2, silence: str = "4000 days",
                        delay: str = "1 day") -> DataFrame:
    """STR2: processed and failed rows per job as results arrive, with state that ends. Results are delivered in
    ranges of their time and the stream is restarted on its checkpoint for every delivery. Returns a row
    per job: completed (the total was reached), silent (no row for ``silence``; its state is gone) or
    processing. A row later than the watermark by more than ``delay`` is dropped; rows of a job that was
    silent for longer are counted anew and added; rows that come after a completed job's state is gone change nothing."""
    src, out, ckpt = scratch_path(spark, "s2-in"), scratch_path(spark, "s2-out"), scratch_path(spark, "s2-ckpt")
    sink = ProgressSink(spark, out, totals, silence, delay)
    secs = F.unix_micros(F.col("created_at").cast("timestamp"))
    lo, hi = results.agg(F.min(secs), F.max(secs)).first()
    width = max(1, ((hi or 0) - (lo or 0)) // deliveries + 1)
    at = F.coalesce(F.floor((secs - F.lit(lo)) / F.lit(width)), F.lit(0))
    for b in range(deliveries):
        results.filter(at == b).write.mode("append").parquet(src)
        run_available(spark.readStream.schema(results.schema).parquet(src), sink, ckpt)
    return sink.read()


def stream_dedupe(spark: SparkSession, events: DataFrame, key: str = "event_id", ts: str = "ts",
                  delay: str = "1 hour", deliveries: int = 4) -> DataFrame:
    """STR3: a re-delivered record (same key) is dropped: within the watermark delay by the state, beyond
    it as late. Events are delivered in ranges of their time, each together with all of the range before
    it once more, and the stream is restarted on its checkpoint for every delivery: so a copy comes in a
    later file and a later run than its original. Events without a time come first."""
    src, out, ckpt = scratch_path(spark, "s3-in"), scratch_path(spark, "s3-out"), scratch_path(spark, "s3-ckpt")
    secs = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = events.agg(F.min(secs), F.max(secs)).first()
    width = max(1, ((hi or 0) - (lo or 0)) // deliveries + 1)
    at = F.coalesce(F.floor((secs - F.lit(lo)) / F.lit(width)), F.lit(0))
    ts_type = dict(events.dtypes)[ts]
    for b in range(deliveries + 1):
        events.filter(at.isin(b - 1, b)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        # watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read as wall-clock UTC and cast back on output
        timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
        run_available(timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]), epoch_sink(out), ckpt)
    return read_epochs(spark, out).drop("epoch").withColumn(ts, F.col(ts).cast(ts_type))


def committed_sink(table: CommittedTable, before_commit=None):
    """foreachBatch body: an epoch is a batch of the table, files first and then its record. ``before_commit`` is
    called in between with the epoch's number (tests raise there)."""
    def run(batch: DataFrame, epoch: int) -> None:
        table.append(batch, f"epoch={epoch}", before_commit and (lambda: before_commit(epoch)))
    return run


def stream_retry_safe_sink(spark: SparkSession, events: DataFrame, n_files: int = 4) -> DataFrame:
    """STR4: the query dies between the files of its second epoch and their commit; a new query on the same
    checkpoint runs that epoch again and the rest. Readers follow commits, so the files of the lost attempt
    are not read, and a committed epoch is not appended twice: every row is there once."""
    src, out, ckpt = scratch_path(spark, "s4-in"), scratch_path(spark, "s4-out"), scratch_path(spark, "s4-ckpt")
    events.repartition(n_files).write.mode("overwrite").parquet(src)
    table = CommittedTable(spark, out, events.schema)

    def lost(epoch):
        if epoch == 1:
            raise RuntimeError("lost before the commit")

    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    try:
        run_available(stream(), committed_sink(table, lost), ckpt)
    except StreamingQueryException:
        run_available(stream(), committed_sink(table), ckpt)
    return table.read()
