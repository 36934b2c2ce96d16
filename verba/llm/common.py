"""Helpers shared by the training-data operators: row keys, written tables, components."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


SCOPE = contextvars.ContextVar("verba_llm_scope", default="")  # folders of the open scratch() blocks


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/verba-llm/{SCOPE.get()}{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is written inside lies in one folder, which is deleted at the end, after an error too. What is to
    stay is written inside to a path that was made before, as a whole: nothing lazy may leave the block."""
    own = f"{SCOPE.get()}{uuid.uuid4().hex}/"
    token = SCOPE.set(own)
    try:
        yield
    finally:
        SCOPE.reset(token)
        discard(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/verba-llm/{own}")


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete files in the shared folder that no later step reads."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *paths: str) -> None:
    """delete(), and let the driver notice that the shuffles of finished steps are garbage: their files go
    with the objects that describe them."""
    import gc

    delete(spark, *paths)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut by files that every
    executor reaches, and later readers prune columns."""
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, id_col: str) -> DataFrame:
    """(_row, _k1, _k2): the whole row as a struct, so that no column name can clash, and its key. Rows
    with equal keys are equal in every column and so interchangeable. The key follows from the contents
    alone and is the same in every scan, unlike a generated row number."""
    def hashable(f):
        return F.to_json(df[f"`{f.name}`"]) if "map<" in f.dataType.simpleString() else df[f"`{f.name}`"]

    fields = df.schema.fields
    return df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"),
        F.coalesce(df[f"`{id_col}`"].cast("long"), F.lit(0).cast("long")).alias("_k1"),
        F.xxhash64(F.lit(1), *[df[f"`{c}`"].isNull() for c in df.columns], *[hashable(f) for f in fields]).alias("_k2"))


def field(name: str):
    """A column of the row that row_key() packed."""
    return F.col("_row").getField(name)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[field(c).alias(c) for c in columns])


def worker_cache(key: str, make):
    """One object per Python worker process: UDF bodies travel by value, so module globals would be
    rebuilt for every task."""
    import sys
    import types

    store = sys.modules.setdefault("_verba_llm_worker", types.ModuleType("_verba_llm_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def forest(u, v):
    """Edges (u[i], v[i]) as numpy integers -> (node, root) with one row per node that isn't its own
    root; root is the smallest node that the given edges connect it to."""
    import numpy as np

    nodes, idx = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = idx[: len(u)], idx[len(u):]
    lab = np.arange(len(nodes))
    while True:
        new = lab.copy()
        np.minimum.at(new, lab[a], lab[b])
        np.minimum.at(new, lab[b], lab[a])
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        new = new[lab]
        if np.array_equal(new, lab):
            break
        lab = new
    own = lab != np.arange(len(nodes))
    return nodes[own], nodes[lab[own]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u long, v long): (node, root), one row per node
    that is not the smallest of its component. Alternating large-star and small-star steps until
    nothing changes, which takes a number of rounds that grows with the logarithm of the nodes; every
    round is written to the shared folder, the one before is deleted, and only a count and a checksum
    reach the driver. The per-node minimum is a combinable aggregate; a node with very many edges is a
    skewed sort-merge join key, which adaptive execution splits."""
    u, v, spark = F.col("u"), F.col("v"), edges.sparkSession
    path = shared_path(spark, "edges")
    e = written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges", path)
    sign = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before, now = None, sign(e)
    while now[0] and now != before:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        old, path = path, shared_path(spark, "edges")
        e = written(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges", path)
        delete(spark, old)
        before, now = now, sign(e)
    return e.select(u.alias("node"), v.alias("root"))
