"""Session construction and the few cluster-facing helpers every plan uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Bytes that a table may hold and still be broadcast to every task.
BROADCAST_MAX_BYTES = 256 << 20


def get_spark(master: str | None = None, app: str = "verba", shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local session without one gets a temp dir."""
    try:
        sc = spark.sparkContext
    except Exception as e:  # a Connect session: the server's spark.checkpoint.dir applies
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder") from e
        return shared
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="verba-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with files in the shared checkpoint folder: Parquet, so that later readers prune columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/verba-tmp/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, size: int, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the measured bytes are within the bound; else leave it to a shuffle join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if size <= max_bytes else df


def spread(df: DataFrame, max_bytes: int = 256 << 20) -> DataFrame:
    """Give per-row-heavy work (regex, n-grams, NFKD) a partition per core. A table of up to ``max_bytes`` (by the
    planner's estimate) may lie in one row group, which no scan can split however many partitions it
    plans, so its rows are dealt out; a larger one has row groups enough and costs no shuffle."""
    if not hasattr(df, "_jdf"):  # a Connect session: leave the layout to the server
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= max_bytes else df


def partitions(df: DataFrame, max_bytes: int = 8 << 20) -> int:
    """Range partitions for ``df``: as many as the session shuffles to, and more where one would get over ``max_bytes``
    of it by the planner's estimate (files' bytes, a fraction of the rows' in memory). Adaptive execution leaves
    a number that is named as it is, so a fixed one would grow each task with the table. A join's estimate is the
    product of its sides, so the bytes that are read bound it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not hasattr(df, "_jdf"):
        return n
    plan = df._jdf.queryExecution().optimizedPlan()
    size = lambda p: int(str(p.stats().sizeInBytes()))
    read = plan.collectLeaves()
    size = min(size(plan), sum(size(read.apply(i)) for i in range(read.size())))
    return max(n, min(10000, -(-size // max_bytes)))
