"""Score-array functions (MDL8-10, VAL6) as higher-order column expressions.

Scores travel as ``array<double>`` in a fixed class order, so softmax and the
temperature rescale are one projection each, with no shuffle and no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verba.functions.text import bound

# ---- fixed values ----
T_MIN, T_MAX, T_DEFAULT = 0.5, 2.0, 1.0
PROB_EPS = 1e-8


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clamp_temperature(t) -> Column:
    """VAL6: clamp to [0.5, 2.0]."""
    return F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), _c(t).cast("double")))


def effective_temperature(t) -> Column:
    """The scaler treats T <= 0 (or null) as 1.0."""
    c = _c(t).cast("double")
    return F.when(c.isNull() | (c <= 0), F.lit(T_DEFAULT)).otherwise(c)


def softmax(logits, t=None) -> Column:
    """MDL8: softmax(logits / T), max-subtracted. A lambda's body is computed anew for every entry, so what all
    entries share (T, the scaled entries, their maximum and sum) is bound once: linear in the entries."""
    temp = effective_temperature(F.lit(T_DEFAULT) if t is None else (F.lit(t) if not isinstance(t, Column) else t))

    def shares(ex):
        return bound(F.aggregate(ex, F.lit(0.0), lambda a, v: a + v), lambda tot: F.transform(ex, lambda v: v / tot))

    def exps(scaled):
        return bound(F.array_max(scaled), lambda m: bound(F.transform(scaled, lambda v: F.exp(v - m)), shares))

    return bound(temp, lambda d: bound(F.transform(_c(logits), lambda v: v / d), exps))


def rescale_probabilities(probs, t=None) -> Column:
    """MDL9: clip to [1e-8, 1-1e-8], log, divide by T, softmax."""
    p = _c(probs)
    logits = F.transform(p, lambda v: F.log(F.greatest(F.lit(PROB_EPS), F.least(F.lit(1 - PROB_EPS), v))))
    return softmax(logits, t)


def best_index(scores) -> Column:
    """MDL10: 1-based position of the highest score; the first position wins a tie."""
    s = _c(scores)
    return F.array_position(s, F.array_max(s)).cast("int")


def best_label(labels, scores) -> Column:
    return F.when(_c(scores).isNotNull(), F.element_at(_c(labels), best_index(scores)))


def round6(col) -> Column:
    return F.round(_c(col), 6)
