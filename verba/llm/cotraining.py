"""Quality classifier by co-training: a text view and a metadata view teach each other over all rows."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import discard, shared_path, worker_cache, written
from verba.llm.textstats import once
from verba.session import bounded_broadcast

LABELLED = 20_000  # labelled rows of smallest hash that are learned from, at most; unlabelled rows take part without a bound
ROUNDS, SURE = 4, 0.97
BUCKETS = 1 << 18  # of a word's hash
FOLDS = 4  # of training rows: a row's wording is judged by the words of the other folds
SPREAD = 1.0  # variance of a word's log odds before its counts are seen
PRIOR_ROWS = 10.0  # rows at the base rate that a metadata value starts with
KEEP = 0.5
NULL = "\0null"


def narrow(docs: DataFrame, id_col: str, text_col: str, value_cols, chars_col: str, keep: list[str]) -> DataFrame:
    """Own names for what the views read, and the columns ``keep`` packed in _row: no name can clash. _m holds
    the metadata values as they are, null being one, and the magnitude of the length."""
    col = lambda c: docs[f"`{c}`"]
    size = col(chars_col).cast("double")
    magnitude = F.floor(F.log2(F.greatest(size, F.lit(0.0)) + 1)).cast("string")
    return docs.select(F.struct(*[col(c) for c in keep], F.lit(0).alias("_")).alias("_row"), col(id_col).cast("long").alias("_i"),
                       F.coalesce(col(text_col).cast("string"), F.lit("")).alias("_t"),
                       F.array(*[F.coalesce(col(c).cast("string"), F.lit(NULL)) for c in value_cols], F.coalesce(magnitude, F.lit(NULL))).alias("_m"))


def with_features(df: DataFrame) -> DataFrame:
    """narrow() -> with _x, what the content looks like in counts per word or character, and _b, the buckets
    of its distinct words, lower-cased and without punctuation at their ends (``looks.py``)."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        from verba.llm import looks as K

        table = worker_cache("looks", K.tables)
        for texts in batches:
            x, words, many = K.looks(texts, table, BUCKETS)
            yield pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(np.arange(0, x.size + 1, K.N_LOOKS, dtype=np.int32), x.ravel()),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), words)], names=["x", "b"])

    look = F.arrow_udf(run, "struct<x array<double>, b array<int>>").asNondeterministic()(F.col("_t"))
    return df.withColumn("_f", look).withColumn("_x", F.col("_f.x")).withColumn("_b", F.col("_f.b")).drop("_f")


# ---------------------------------------------------------------- text view

def word_weights(good, bad, n_good: float, n_bad: float):
    """Log odds of words for good rows, from the rows that they occur in; drawn to 0 by their uncertainty."""
    import numpy as np

    lo = np.log((good + 0.5) / (n_good + 1)) - np.log((bad + 0.5) / (n_bad + 1))
    return np.where(good + bad > 0, lo * SPREAD / (SPREAD + 1 / (good + 0.5) + 1 / (bad + 0.5)), 0.0).astype(np.float32)


def _wording(w, rows, size):
    """Of each row's word weights: their sum, drawn together, and their mean."""
    import numpy as np

    total = np.bincount(rows, w, len(size))
    return np.stack([np.sign(total) * np.log1p(np.abs(total)), total / np.maximum(size, 1)], axis=1)


def read_and_weighed(text, weights):
    """UDF: the features of a text and its wording by ``weights``, in one array, without its words in between."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        from verba.llm import looks as K

        table, width = worker_cache("looks", K.tables), K.N_LOOKS + 2
        for texts in batches:
            x, words, many = K.looks(texts, table, BUCKETS)
            z = np.concatenate([x, _wording(weights[words], np.repeat(np.arange(len(many)), many), many)], axis=1)
            yield pa.ListArray.from_arrays(np.arange(0, width * len(many) + 1, width, dtype=np.int32), z.ravel())

    return F.arrow_udf(run, "array<double>").asNondeterministic()(text)


def wording(buckets, fold, weights: list):
    """UDF: the wording of a row's words; ``weights`` by fold, the last one of all rows."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow.compute as pc

        table = np.stack(weights)
        for lists, folds in batches:
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            rows = np.repeat(np.arange(len(size)), size)
            pair = _wording(table[np.asarray(folds)[rows], np.asarray(lists.flatten())], rows, size)
            yield pa.ListArray.from_arrays(np.arange(0, 2 * len(size) + 1, 2, dtype=np.int32), pair.ravel())

    return F.arrow_udf(run, "array<double>").asNondeterministic()(buckets, fold)


def count_words(rows: DataFrame):
    """rows (y, _fold, _b) -> (rows by fold and class, word rows by fold, class and bucket): sums of all rows,
    grouped by bucket; what reaches the driver has a fixed size."""
    import numpy as np

    kinds = [(f, y) for f in range(FOLDS) for y in (0, 1)]
    total = np.zeros((FOLDS, 2))
    for r in rows.groupBy("_fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        total[r["_fold"], int(r["y"])] = r["n"]
    got = rows.select("y", "_fold", F.explode("_b").alias("b")).groupBy("b").agg(
        *[F.count_if((F.col("_fold") == f) & (F.col("y") == y)).alias(f"n{f}_{y}") for f, y in kinds]).toArrow()
    words = np.zeros((FOLDS, 2, BUCKETS))
    for f, y in kinds:
        words[f, y, np.asarray(got["b"])] = np.asarray(got[f"n{f}_{y}"])
    return total, words


def fold_weights(total, words) -> list:
    """Word weights without each fold, then of all."""
    out = []
    for left in [*range(FOLDS), None]:
        t, w = (a.sum(axis=0) - (a[left] if left is not None else 0) for a in (total, words))
        out.append(word_weights(w[1], w[0], t[1], t[0]))
    return out


def fit_sums(rows: DataFrame, start, ridge: float = 1.0, steps: int = 12):
    """Logistic regression on rows (x array, y) by Newton steps on standardised columns; every step's gradient and
    Hessian are sums over all rows, per task and then grouped -> (coefficients, intercept)."""
    import numpy as np

    def summed(f, size):
        def run(batches):
            out = np.zeros(size)
            for batch in batches:
                y = np.asarray(batch.column("y"))
                if len(y):
                    out += f(np.asarray(batch.column("x").flatten()).reshape(len(y), -1), y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], names=["k", "v"])

        got = np.zeros(size)
        for r in rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            got[r["k"]] = r["v"]
        return got

    d = len(start) - 1
    m = summed(lambda x, y: np.r_[len(y), x.sum(axis=0), (x * x).sum(axis=0)], 2 * d + 1)
    mean, std = m[1: d + 1] / m[0], np.sqrt(np.maximum(m[d + 1:] / m[0] - (m[1: d + 1] / m[0]) ** 2, 0))
    std[std < 1e-9] = 1.0
    keep = ridge * np.r_[np.ones(d), 1e-6]
    w = np.r_[start[:-1] * std, start[-1] + start[:-1] @ mean]
    for _ in range(steps):
        def parts(x, y, w=w):
            z = np.c_[(x - mean) / std, np.ones(len(x))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.r_[z.T @ (y - p), ((z * (p * (1 - p) + 1e-9)[:, None]).T @ z).ravel()]

        s = summed(parts, d + 1 + (d + 1) ** 2)
        step = np.linalg.solve(s[d + 1:].reshape(d + 1, d + 1) + np.diag(keep), s[: d + 1] - keep * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    c = w[:-1] / std
    return np.r_[c, w[-1] - c @ mean]


def _linear(array: str, w):
    terms = [F.col(array)[i] * F.lit(float(v)) for i, v in enumerate(w[:-1])]
    return sum(terms[1:], terms[0]) + F.lit(float(w[-1]))


def text_margin(rows: DataFrame, model: dict, fold) -> DataFrame:
    """with_features() -> with _z, the features and the wording in one array, and _zt, the text view's log odds."""
    rows = rows.withColumn("_w", wording(F.col("_b"), fold, model["words"]))
    return rows.withColumn("_z", F.concat("_x", "_w")).drop("_w").withColumn("_zt", _linear("_z", model["text"]))


# ---------------------------------------------------------------- metadata view

def fit_values(rows: DataFrame, n_values: int):
    """rows (y, _m) -> (log odds at the base rate, table (c, v, w) of each column's values): a value's log odds
    against the base rate, with PRIOR_ROWS rows at that rate before its own are counted."""
    total = rows.agg(F.sum("y").alias("g"), F.count(F.lit(1)).alias("n")).first()
    rate = (total["g"] + 1.0) / (total["n"] + 2.0)
    values = rows.select("y", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("_m")[c].alias("v")) for c in range(n_values)])).alias("x"))
    sums = values.groupBy("x.c", "x.v").agg(F.sum("y").alias("g"), F.count(F.lit(1)).alias("n"))
    w = F.log((F.col("g") + PRIOR_ROWS * rate) / (F.col("n") - F.col("g") + PRIOR_ROWS * (1 - rate))) - F.lit(_logit(rate))
    return _logit(rate), written(sums.select("c", "v", w.alias("w")), "values")


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def meta_margin(rows: DataFrame, model: dict) -> DataFrame:
    """with _zm, the metadata view's log odds: the base rate's and those of each value; unknown values add nothing."""
    base, table, size = model["meta"]
    out = rows.withColumn("_zm", F.lit(float(base)))
    for c in range(model["n_values"]):
        one = bounded_broadcast(table.where(F.col("c") == c).select(F.col("v").alias("_v"), F.col("w").alias("_vw")), size)
        out = out.join(one, F.col("_m")[c] == F.col("_v"), "left").withColumn("_zm", F.col("_zm") + F.coalesce("_vw", F.lit(0.0))).drop("_v", "_vw")
    return out


# ---------------------------------------------------------------- exchange

def _told(z: str):
    """A view's pseudo-label: 1 or 0 where it is sure of a row, else null. By a threshold, over all rows."""
    limit = F.lit(_logit(SURE))
    return F.when(F.col(z) >= limit, F.lit(1.0)).when(F.col(z) <= -limit, F.lit(0.0))


def _small_fit(x, y):
    """Logistic regression in the driver, on the held-out labelled rows' margins (at most LABELLED rows)."""
    import numpy as np

    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    keep = np.r_[np.full(x.shape[1], 0.05), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, value_cols: list[str], chars_col: str,
          labelled: int = LABELLED, rounds: int = ROUNDS) -> dict | None:
    """Fit both views. ``labelled`` rows of the labels at most are learned from; a fifth of them never trains: it
    calibrates the views and combines them. Of all other rows, the views' features are written once.

    Each round both views score every unlabelled row, and each is refitted on the labelled rows and all rows
    that the other one is sure of, from sums over them. It ends after ``rounds``, or when no view has
    anything new to hand on. None without labels of both kinds in both parts."""
    import numpy as np

    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_i")).agg(
        (F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    base = narrow(docs, id_col, text_col, value_cols, chars_col, [])
    ids = base.select("_i").where("_i IS NOT NULL").distinct()
    own = marks.join(ids, "_i", "left_semi").orderBy(F.xxhash64("_i"), "_i").limit(labelled)
    own = written(own.withColumn("_held", F.pmod(F.xxhash64(F.lit(5), "_i"), F.lit(5)) == 0), "marks")
    kinds = {(r["_held"], r["_y"]) for r in own.select("_held", "_y").distinct().collect()}
    if len(kinds) < 4 or own.count() < 20:
        return None
    fold = F.coalesce(F.pmod(F.xxhash64(F.lit(6), "_i"), F.lit(FOLDS)), F.lit(0)).cast("int")
    rows = with_features(base.join(F.broadcast(own), "_i", "left")).select(  # ``labelled`` rows at most
        F.col("_y").cast("double").alias("_y"), F.coalesce("_held", F.lit(False)).alias("_held"), fold.alias("_fold"), "_x", "_b", "_m")
    spark, views = docs.sparkSession, shared_path(docs.sparkSession, "views")
    rows = written(rows, "views", views)
    n_values, known = len(value_cols) + 1, F.when(~F.col("_held"), F.col("_y"))
    whole, of_row = F.lit(FOLDS), F.col("_fold")
    model = {"n_values": n_values, "text": np.zeros(14), "told": []}

    def learn_text(taught: DataFrame) -> None:
        model["words"] = fold_weights(*count_words(taught))
        path = shared_path(spark, "taught")
        fitted = written(text_margin(taught, model, of_row).select(F.col("_z").alias("x"), "y"), "taught", path)
        model["text"] = fit_sums(fitted, model["text"])
        discard(spark, path)

    def learn_meta(taught: DataFrame) -> None:
        rate, table = fit_values(taught.select("y", "_m"), n_values)
        n, size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("v"))).first()
        model["meta"] = rate, table, n * 48 + (size or 0)

    first = rows.withColumn("y", known).where("y IS NOT NULL")
    learn_text(first)
    learn_meta(first)
    before = None
    for _ in range(rounds):
        scored = meta_margin(text_margin(rows, model, F.when(F.col("_y").isNotNull() & ~F.col("_held"), of_row).otherwise(whole)), model)
        scored = scored.withColumn("_open", F.col("_y").isNull()).withColumn("_from_text", F.when(F.col("_open"), _told("_zt"))) \
            .withColumn("_from_meta", F.when(F.col("_open"), _told("_zm")))
        # what each view is taught from: the metadata of the rows that the text view is sure of, and the other way round
        paths = shared_path(spark, "for-meta"), shared_path(spark, "for-text")
        scored = scored.withColumn("_for_meta", F.coalesce(known, "_from_text")).withColumn("_for_text", F.coalesce(known, "_from_meta"))
        told = tuple(written(scored.select("_from_text", "_from_meta", F.col("_for_meta").alias("y"), "_m"), "for-meta", paths[0])
                     .agg(*[F.count_if(F.col(c) == y) for c in ("_from_text", "_from_meta") for y in (0, 1)]).first())
        model["told"].append(told)
        if told == before or not any(told):
            discard(spark, paths[0])
            break
        if any(told[2:]):
            for_text = written(scored.where("_for_text IS NOT NULL").select(F.col("_for_text").alias("y"), "_fold", "_x", "_b"), "for-text", paths[1])
        if any(told[:2]):
            learn_meta(spark.read.parquet(paths[0]).where("y IS NOT NULL"))
        if any(told[2:]):
            learn_text(for_text)
        discard(spark, *paths)
        before = told
    held = meta_margin(text_margin(rows.where("_held AND _y IS NOT NULL"), model, whole), model).select("_zt", "_zm", "_y").toPandas()
    z, y = held[["_zt", "_zm"]].to_numpy(), held["_y"].to_numpy()
    model["calibrated"] = [_small_fit(z[:, [k]], y).tolist() for k in (0, 1)]
    logits = np.stack([z[:, k] * c[0] + c[1] for k, c in enumerate(model["calibrated"])], axis=1)
    model["combined"] = _small_fit(logits, y).tolist()
    discard(spark, views)
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text",
             value_cols: tuple[str, ...] = ("source", "lang"), chars_col: str = "n_chars", model: dict | None = None) -> DataFrame:
    """``docs`` with p_text, p_meta (each view's calibrated probability of good quality), score (of both) and
    kept (score of at least KEEP). All rows and whole texts are scored.

    Null text is empty; null metadata are values of their own; ids may be null or repeat: rows are
    scored one by one. Labels with a null id or value are left out, several of one id are averaged. A
    model needs some labels of both kinds: without, the views say nothing (null), every score is 1 and every
    row is kept. Empty table: no rows. Columns of ``docs`` that have the four names are replaced."""
    model = model or train(docs, labels, id_col, label_col, text_col, list(value_cols), chars_col)
    keep = [c for c in docs.columns if c not in ("p_text", "p_meta", "score", "kept")]
    df = narrow(docs, id_col, text_col, value_cols, chars_col, keep)
    if model is None:
        df = df.withColumn("_a", F.lit(None).cast("double")).withColumn("_c", F.col("_a")).withColumn("_s", F.lit(1.0))
    else:
        df = df.withColumn("_z", read_and_weighed(F.col("_t"), model["words"][-1])).withColumn("_zt", _linear("_z", model["text"]))
        df = meta_margin(df, model)
        logit = [F.col(z) * F.lit(a) + F.lit(b) for z, (a, b) in zip(("_zt", "_zm"), model["calibrated"], strict=True)]
        wt, wm, b = model["combined"]
        df = df.withColumn("_a", _logistic(logit[0])).withColumn("_c", _logistic(logit[1])).withColumn(
            "_s", _logistic(logit[0] * F.lit(wt) + logit[1] * F.lit(wm) + F.lit(b)))
    df = df.withColumn("_once", once())
    return df.select(*[F.col("_row").getField(c).alias(c) for c in keep], F.col("_a").alias("p_text"), F.col("_c").alias("p_meta"),
                     F.col("_s").alias("score"), ((F.col("_s") >= KEEP) & F.col("_once")).alias("kept"))


def _logistic(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   value_cols: tuple[str, ...] = ("source", "lang"), chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with all columns of ``docs``."""
    need = list(dict.fromkeys([id_col, text_col, *value_cols, chars_col]))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_whole"), *[docs[f"`{c}`"] for c in need])
    kept = classify(whole, labels, id_col, text_col=text_col, value_cols=value_cols, chars_col=chars_col, **options).where("kept")
    return kept.select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])
