"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verba.llm.common import WORD, field, row_key, unpacked, written


def size_of(text):
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``name``: 0..n-1 in the order of the columns. The rows are range-partitioned and written, so
    that counts and rows come from the same partitions; the offsets are sums over one row a partition."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order) \
        .withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = written(parts, "numbered")
    count = parts.groupBy("_p").agg(F.max("_i").alias("_n"))  # at most one row for each shuffle partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select("_p", F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0)).alias("_o"))
    return parts.join(F.broadcast(offset), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """sizes (source, size) -> written (source, source_size, target).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target
    stops at ``cap`` times its source's size; the excess goes to the others by weight until none is
    above: target = min(cap * size, level * weight), where every round fixes the sources that reached
    their cap and sums up the rest. Only two sums a round reach the driver."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(own, [F.col("source").isNull(), F.encode("source", "UTF-8")], "_r")
    at = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(ranked.withColumn("_w", at[(F.col("_r") % len(weights)).cast("int")])
                     .withColumn("_cap", F.col("source_size") * F.lit(cap)), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        reached = F.lit(False) if level is None else F.col("_cap") <= F.lit(level) * F.col("_w")
        n, fixed, weight = ranked.agg(F.count_if(reached), F.sum(F.when(reached, F.col("_cap")).otherwise(0.0)),
                                      F.sum(F.when(reached, 0.0).otherwise(F.col("_w")))).first()
        if n == full or not weight:
            break
        full, level = n, (total - fixed) / weight
    target = F.col("_cap") if not weight else F.least("_cap", F.lit(level) * F.col("_w"))
    return ranked.select("source", "source_size", (target if total else F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 42, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: _k1, _k2, the id, source, size, source_size, target, copies, taken.

    Each document expects target / source_size copies. Within a source documents are lined up by size,
    id and row key; a document takes a copy for each whole number between its prefix sums plus the
    source's random offset (from the source's name and the seed, so reruns agree). By size: the sample
    then has documents of all sizes in proportion, and the words taken miss the target by about one large
    document at most. The ranks
    come from range partitions on (source, size, ...), so that a source with a third of all rows spans
    many tasks. Null text has size 0; null source is a source; ids may be null (lined up as 0) or
    repeat; equal rows are interchangeable. A source of size 0 has target 0. Empty table: no rows."""
    keyed = row_key(docs, id_col).select("_k1", "_k2", field(id_col).alias("_id"), field(source_col).cast("string").alias("source"),
                                         size_of(field(text_col)).alias("size"))
    rows = numbered(keyed, [F.col("source").isNull(), F.encode("source", "UTF-8"), "size", "_k1", "_k2"], "_r")
    rows = written(rows, "rows")
    targets = source_targets(rows.select("source", "size"), weights, cap)
    firsts = rows.groupBy("source").agg(F.min("_r").alias("_f"))
    plan = targets.join(firsts, targets["source"].eqNullSafe(firsts["source"])).select(
        targets["source"].alias("_s"), "source_size", "target", "_f", F.try_divide("target", "source_size").alias("_e"),
        offset_of(targets["source"], seed).alias("_u"))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    e, u, k = F.coalesce("_e", F.lit(0.0)), F.col("_u"), F.col("_r") - F.col("_f")
    copies = F.floor(u + (k + 1) * e) - F.floor(u + k * e)
    return out.select("_k1", "_k2", F.col("_id").alias(id_col), "source", "size", "source_size", "target",
                      copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def offset_of(source, seed: int):
    """A number in [0, 1) from the source's name and the seed."""
    name = F.coalesce(F.concat(F.lit(f"{seed}:"), source), F.lit(f"{seed}"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with its columns: each row as often as the mix takes it, equal rows summed up."""
    plan = mix(docs, id_col=id_col, **options).where("copies > 0").groupBy("_k1", "_k2").agg(F.sum("copies").alias("_n"))
    rows = row_key(docs, id_col).join(plan, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return unpacked(rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))), docs.columns)
