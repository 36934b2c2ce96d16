"""Feature counts of labelled texts (LNG1, MDL3, MDL4) as a long table that batches add to.

A row is (m, label, f, n): of model ``m``, feature ``f`` occurs ``n`` times in texts of class ``label``; a
null feature with m = -1 counts texts. Classes are rows, so their number has no bound, and counts of
parts add up to the counts of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "m int, label string, f string, n long"
TEXTS = -1  # the model number under which texts are counted


def count_features(corpus: DataFrame, label: str, features: list[tuple[str, Column]]) -> DataFrame:
    """Counts of a corpus, one pass: ``features`` has for each model "gram" and a text column, or "word" and
    an array of tokens. Arrow batches are counted in numpy, so the shuffle moves a row per distinct
    feature, class and batch, not one per occurrence. Rows without a label don't count."""
    kinds = [kind for kind, _ in features]
    rows = corpus.select(F.col(label).cast("string").alias("label"), *[c.alias(f"x{i}") for i, (_, c) in enumerate(features)]) \
        .where(F.col("label").isNotNull())

    def run(batches, kinds=tuple(kinds)):
        import numpy as np
        import pyarrow as pa

        from verba.functions import grams as G

        def out(m, names, labels, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), m), pa.int32()), pa.array(labels, pa.string()),
                                               pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["m", "label", "f", "n"])

        for batch in batches:
            d = batch.column("label").dictionary_encode()
            names, of = d.dictionary.to_pylist(), np.asarray(d.indices)
            if not len(of):
                continue
            yield out(TEXTS, [None] * len(names), names, np.bincount(of, minlength=len(names)))
            for m, kind in enumerate(kinds):
                x = batch.column(f"x{m}")
                if kind == "gram":
                    for keys, at, n in G.gram_counts(x, of, len(names)):
                        yield out(m, G.unpacked(keys), [names[k] for k in at.tolist()], n)
                else:
                    for words, index, owner in G.tokens(x):
                        both, n = G.tally(index.astype(np.int64) * len(names) + of[owner], len(words) * len(names))
                        yield out(m, [words[k] for k in (both // len(names)).tolist()], [names[k] for k in (both % len(names)).tolist()], n)

    return summed(rows.mapInArrow(run, SCHEMA))


def summed(counts: DataFrame) -> DataFrame:
    """Counts of the same feature and class as one row: how parts are merged."""
    return counts.groupBy("m", "label", "f").agg(F.sum("n").alias("n"))


class CountTable:
    """Counts kept under a path, a folder per batch: a batch that is added again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, counts: DataFrame, batch: str) -> None:
        counts.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def totals(self) -> DataFrame:
        return summed(self.spark.read.schema(SCHEMA).parquet(self.path))
