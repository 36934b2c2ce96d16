"""Sharding by extendible hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import field, row_key, written

BITS = 60  # of a hash; the low SALT ones tell equal rows apart
SALT = 20
STEP = 10  # bits that a round looks at


def shard_directory(rows: DataFrame, limit: int) -> DataFrame:
    """rows (h: BITS bits, size) -> the directory, written: depth, prefix, shard_bytes, shard_rows of every
    bucket, which together hold each hash once.

    A bucket of more than ``limit`` bytes splits on its next bit, until it fits or has one row or no
    bits left. A round sums up the oversized buckets by their next STEP bits, adds up each of the STEP
    splits from those cells, and goes on with the cells that are still too large. Only sums move."""
    done, open_ = None, None
    depth = 0
    while depth < BITS:
        top = depth + STEP
        sums = rows if open_ is None else rows.join(open_.select(F.col("prefix").alias("_p")),
                                                    F.shiftright("h", BITS - depth) == F.col("_p"), "left_semi")
        cell = written(sums.groupBy(F.shiftright("h", BITS - top).alias("cell")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "cells")
        # every split of this round: a row for each bit and cell, summed up to prefixes
        up = cell.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(top)))).select(
            "d", F.expr(f"shiftright(cell, {top} - d)").alias("prefix"), "size", "n")
        node = up.groupBy("d", "prefix").agg(F.sum("size").alias("size"), F.sum("n").alias("n")) \
            .withColumn("fits", (F.col("size") <= F.lit(limit)) | (F.col("n") <= 1) | (F.col("d") == BITS))
        inner = node.where("NOT fits").select("d", "prefix", F.lit(True).alias("_in"))
        # a bucket is where its parent has split and it has not; the first round's root has no parent
        parent = inner.select((F.col("d") + 1).alias("d"), F.col("prefix").alias("_q"))
        born = node.join(parent, (node["d"] == parent["d"]) & (F.shiftright(node["prefix"], 1) == F.col("_q")), "left_semi")
        if open_ is None:
            born = born.unionByName(node.where("d = 0"))
        born = written(born.select("d", "prefix", "size", "n", "fits"), "buckets")
        leaves = born.where("fits").select(F.col("d").alias("depth"), "prefix", F.col("size").alias("shard_bytes"),
                                           F.col("n").alias("shard_rows"))
        done = leaves if done is None else done.unionByName(leaves)
        open_ = written(born.where(f"NOT fits AND d = {top}").select("prefix"), "open")
        depth = top
        if open_.isEmpty():
            break
    return written(done, "directory")


def shard(docs: DataFrame, limit: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _k1, _k2, the id, n_bytes, shard (depth and hash prefix, e.g. ``3-101``),
    depth, shard_bytes and shard_rows.

    The hash comes from the whole row, so reruns agree, and for its low bits from the row's place in the
    input, so that a bucket of equal rows can split as well. A shard holds at most ``limit`` bytes of
    text unless a single text is larger. Null and empty texts have no bytes; ids may be null or repeat.
    Empty table: no rows."""
    text = field(text_col).cast("binary")
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << SALT) - 1))
    high = F.shiftrightunsigned(F.xxhash64("_k2", "_k1"), 64 - (BITS - SALT))
    rows = written(row_key(docs, id_col).select(
        "_k1", "_k2", field(id_col).alias("_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"),
        (F.shiftleft(high, SALT) + place).alias("h")), "rows")
    directory = shard_directory(rows.select("h", "size"), limit)
    depths = [r["depth"] for r in directory.select("depth").distinct().collect()]  # BITS + 1 values at most
    # a row's bucket is the one of its prefixes that the directory has
    keys = rows.withColumn("_x", F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in sorted(depths)] or [
        F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))])))
    out = keys.select("_k1", "_k2", "_id", "size", "_x.depth", "_x.prefix").join(directory, ["depth", "prefix"])
    bits = F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise("")
    return out.select("_k1", "_k2", F.col("_id").alias(id_col), F.col("size").alias("n_bytes"),
                      F.concat_ws("-", F.col("depth").cast("string"), bits).alias("shard"), "depth", "shard_bytes", "shard_rows")
