"""Ensembles.

Long form ``(id, model, label, score)`` handles models with different label
sets (union of labels, a missing score counts 0.0, mean over the models that
answered). The flagship uses the array form, where all models of a task share
one class order and the mean is a per-element ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verba.functions import scores as SC

KNOWN_METHODS = ("average",)


def ensemble_long(scores: DataFrame, id_cols: list, method: str = "average") -> DataFrame:
    """ENS1/ENS2/ENS4 in long form. Rows with a null score are failed models and are left out.
    One groupBy per id: the group holds (models x labels) entries, bounded by the label sets,
    and the average, the union of labels and the pick are array expressions on it.
    Returns one row per id: prediction, confidence, n_models, method_used, fallback.
    Ties: score desc, then label asc."""
    ok = scores.filter(F.col("score").isNotNull())
    g = ok.groupBy(*id_cols).agg(F.collect_list(F.struct("model", "label", "score")).alias("r"))
    n = F.size(F.array_distinct(F.transform("r", lambda x: x["model"])))
    labels = F.array_sort(F.array_distinct(F.transform("r", lambda x: x["label"])))
    avg = F.transform(labels, lambda lab: F.struct(
        lab.alias("label"),
        (F.aggregate(F.filter("r", lambda x: x["label"] == lab), F.lit(0.0), lambda a, x: a + x["score"]) / n)
        .alias("score")))
    first = F.element_at(avg, 1)
    best = F.aggregate(avg, first, lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    return g.select(
        *id_cols,
        best["label"].alias("prediction"),
        best["score"].alias("confidence"),
        n.alias("n_models"),
        F.lit("average").alias("method_used"),
        F.lit(method not in KNOWN_METHODS).alias("fallback"),
    )


def ensemble_arrays(score_arrays: list) -> Column:
    """Array form: element-wise mean over the non-null model arrays (same class order)."""
    arrs = F.filter(F.array(*score_arrays), lambda a: a.isNotNull())
    n = F.size(arrs)
    first = F.element_at(arrs, 1)
    return F.when(
        n > 0,
        F.transform(first, lambda _x, k: F.aggregate(arrs, F.lit(0.0), lambda acc, a: acc + a[k]) / n),
    )


def individual_results(labels: list, score_arrays: dict) -> Column:
    """ENS3: map model -> struct(label, confidence, all_scores); null when fewer than two models answered."""
    lab = F.array(*[F.lit(x) for x in labels])
    entries = []
    for key, arr in score_arrays.items():
        entries.append(F.when(arr.isNotNull(), F.struct(
            F.lit(key).alias("key"),
            F.struct(
                SC.best_label(lab, arr).alias("label"),
                F.array_max(arr).alias("confidence"),
                F.map_from_arrays(lab, arr).alias("all_scores"),
            ).alias("value"),
        )))
    present = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return F.when(F.size(present) > 1, F.map_from_entries(present))
