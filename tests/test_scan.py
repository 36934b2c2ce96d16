"""Running aggregates against a plain loop, with one key of a third of all rows."""

import random

from pyspark.sql import functions as F

from verba.operators.scan import running


def test_running_over_partitions(spark):
    rng = random.Random(4)
    rows = [(7 if k % 3 else rng.randint(0, 5), k, rng.randint(-9, 9)) for k in range(900)] + [(None, k, k) for k in range(40)] + [(8, 1, None)]
    want, total = {}, {}
    for key, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s, x = total.get(key, (0, 0))
        total[key] = (s + (v or 0), x ^ (v or 0))
        want[key, k] = total[key]
    df = spark.createDataFrame(rows, "key long, k long, v long").repartition(5)
    got = running(df, ["key"], ["k"], {"s": ("sum", F.col("v")), "x": ("xor", F.col("v"))})
    assert got.columns == ["key", "k", "v", "s", "x"]
    assert {(r["key"], r["k"]): (r["s"] or 0, r["x"] or 0) for r in got.collect()} == want
    assert running(df.limit(0), ["key"], ["k"], {"s": ("sum", F.col("v"))}).count() == 0
