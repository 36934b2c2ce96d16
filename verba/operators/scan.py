"""Running aggregates within a key whose rows may fill many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verba.session import materialize

# kind -> aggregate function, how two of its results combine, its result over nothing
KINDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
    "max": (F.max, lambda a, b: F.greatest(a, b), None),
}


def running(df: DataFrame, key: list[str], order: list[str], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with, for each ``name: (kind, value)`` of ``measures``, the aggregate of the values of the rows
    of the same ``key`` up to and with this one in ``order`` (nulls first).

    A segmented prefix sum: rows are dealt to range partitions by key and order, so a key with a third of
    all rows spans as many tasks as its share; each task runs up its own part of a key, and a key that
    goes on from earlier partitions gets their totals as a carry. Only the first and the last key of a
    partition can span partitions, so the carries are two rows a partition at most. Rows equal in key
    and order share a partition and are ordered arbitrarily. Null keys are a key. Empty table: no rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, (_, value) in measures.items():
        df = df.withColumn(name, value)
    rows = materialize(df.repartitionByRange(n, *key, *order).withColumn("_p", F.spark_partition_id()))
    here = Window.partitionBy("_p", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select(*[c for c in rows.columns if c not in measures],
                      *[KINDS[kind][0](name).over(here).alias(name) for name, (kind, _) in measures.items()])
    k = F.struct(*key)
    ends = rows.groupBy("_p").agg(F.min(k).alias("_lo"), F.max(k).alias("_hi"))
    totals = rows.join(F.broadcast(ends), "_p").where(k.eqNullSafe(F.col("_lo")) | k.eqNullSafe(F.col("_hi"))).groupBy("_p", *key).agg(
        *[KINDS[kind][0](name).alias(name) for name, (kind, _) in measures.items()])
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("_p").alias("_q"), F.struct(*key).alias("_k"), F.count(F.lit(1)).over(before).alias("_n"),
                          *[KINDS[kind][0](name).over(before).alias(f"_c_{name}") for name, (kind, _) in measures.items()])
    carry = materialize(carry.where("_n > 0"))  # a row for each partition at most
    out = own.join(F.broadcast(carry), (F.col("_p") == F.col("_q")) & k.eqNullSafe(F.col("_k")), "left")

    def whole(name):
        kind = KINDS[measures[name][0]]
        nothing = F.lit(kind[2])
        return F.when(F.col("_n").isNull(), F.col(name)).otherwise(
            kind[1](F.coalesce(F.col(f"_c_{name}"), nothing), F.coalesce(F.col(name), nothing)))

    return out.select(*[whole(c).alias(c) if c in measures else F.col(c) for c in own.columns if c != "_p"])
