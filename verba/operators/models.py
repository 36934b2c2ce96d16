"""Models and scoring, trained and applied as Spark jobs.

The reference's pretrained transformers are re-aimed as table-driven models: two multinomial naive
Bayes models per text task (word tokens, character trigrams) and two prototype models for the topic
task (``topics.py``). Training sums feature counts (``counts.py``). Scoring looks the features of a whole
Arrow batch of texts up in the model's weight matrix, which goes along to the tasks while it is within
MODEL_MAX_BYTES: a projection of the scan, without a row per feature and without a shuffle. A larger
model is joined with per-text counts instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.functions import text as T
from verba.operators.counts import TEXTS, count_features
from verba.operators.plugins import PluginModel
from verba.operators.registry import REGISTRY, TASK_CLASSES, output_label
from verba.session import materialize
from verba.sources.tables import load

MODEL_MAX_BYTES = 128 << 20  # of a model's names and weights that go along with every task
SUMS = "struct<s array<double>, n long, seconds double>"


def model_text(col, truncate: bool = True) -> Column:
    """What a model sees when no language/translation step runs: clean, then normalise. Scored texts are
    cut to the model's input length; training texts are not."""
    return T.normalize_text(T.clean_text(col), truncate)


def task_corpus(spark: SparkSession, sf_dir: str, task: str, cleaned_docs: DataFrame | None = None) -> DataFrame:
    """labels joined to documents; raw class per FIXTURES §3. With ``cleaned_docs`` the corpus also carries
    the already-cleaned text as ``cleaned``."""
    lab = load(spark, sf_dir, "labels")
    if cleaned_docs is not None:
        docs = cleaned_docs.select("doc_id", "text", "cleaned")
    else:
        docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    if task == "spam":
        raw = F.when(F.col("quality") == 0, "LABEL_1").otherwise("LABEL_0")
    elif task == "sentiment":
        raw = F.when(F.col("toxic") == 1, "Negative").otherwise("Positive")
    else:
        raise ValueError(task)
    extra = ["cleaned"] if cleaned_docs is not None else []
    return lab.join(docs, "doc_id").select("doc_id", raw.alias("label"), "text", *extra)


# ---------------------------------------------------------------- count models

@dataclass
class CountModel:
    """Multinomial naive Bayes from feature counts with add-one smoothing. ``dense``: a row per feature with
    its count in each class that it occurs in."""
    key: str
    kind: str                   # "word", or "gram": character trigrams
    classes: list
    log_priors: list
    totals: list                # features in the texts of each class
    n_features: int             # distinct
    dense: DataFrame            # (f string, c map<string,long>)
    labels: list = field(default_factory=list)
    task: str = ""
    _packed: tuple | None = None

    @property
    def weights(self) -> DataFrame:
        """(f, w): log weight per class, in the order of ``classes``."""
        w = F.array(*[F.log((F.coalesce(F.col("c")[c], F.lit(0)) + 1) / F.lit(float(t + self.n_features)))
                      for c, t in zip(self.classes, self.totals, strict=True)])
        return self.dense.select("f", w.alias("w"))

    def packed(self, max_bytes: int | None = None):
        """(names, matrix) on the driver, or None where they would hold more than MODEL_MAX_BYTES."""
        if self.n_features * (8 * len(self.classes) + 40) > (MODEL_MAX_BYTES if max_bytes is None else max_bytes):
            return None
        if self._packed is None:
            import numpy as np

            got = self.weights.toArrow()
            self._packed = got["f"].to_pylist(), np.asarray(got["w"].combine_chunks().flatten()).reshape(-1, len(self.classes))
        return self._packed

    def input(self, text) -> Column:
        return T.word_tokens(text) if self.kind == "word" else text

    def sums(self, text) -> Column:
        """Struct of the sums of log weights per class, the number of known features and the seconds spent
        (the row's share of its batch); a projection, for packed models."""

        (names, matrix), kind, k = self.packed(), self.kind, len(self.classes)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import time

            import numpy as np

            from verba.functions import grams as G

            if kind == "word":
                place = {w: i for i, w in enumerate(names)}
            else:
                index = G.GramIndex(G.packed(names))
            for x in batches:
                began, n = time.perf_counter(), len(x)
                s, hits = np.zeros((n, k)), np.zeros(n, dtype=np.int64)
                if kind == "word":
                    parts = ((owner, np.array([place.get(w, -1) for w in words], dtype=np.int64)[at]) for words, at, owner in G.tokens(x))
                else:
                    parts = ((owner, index.found(points, at)) for points, at, owner in G.windows(x))
                for owner, at in parts:
                    part, hit = G.row_sums(owner, at, matrix, n)
                    s += part
                    hits += hit
                share = (time.perf_counter() - began) / max(1, n)
                yield pa.StructArray.from_arrays([
                    pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), s.ravel()), pa.array(hits), pa.array(np.full(n, share))],
                    names=["s", "n", "seconds"])

        return F.arrow_udf(run, SUMS).asNondeterministic()(self.input(text))


def models_from_counts(counts: DataFrame, specs: list[tuple[str, str]], classes: list | None = None, task: str = "") -> list[CountModel]:
    """Models from a count table (``counts.py``); specs: (key, kind) by model number. The classes are those of
    the table, sorted, unless given. What reaches the driver: a row per model and class."""
    counts = materialize(counts)
    by = counts.groupBy("m", "label").agg(F.sum("n").alias("n")).collect()
    texts = {r["label"]: r["n"] for r in by if r["m"] == TEXTS}
    classes = classes or sorted(texts)
    n = sum(texts.get(c, 0) for c in classes)
    priors = [math.log((texts.get(c, 0) + 1) / (n + len(classes))) for c in classes]
    known = F.col("label").isin(classes) if len(classes) < len(texts) else F.lit(True)
    dense = materialize(counts.where((F.col("m") != TEXTS) & known).groupBy("m", "f").agg(  # a list of classes each
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("c")))
    features = {r["m"]: r["v"] for r in dense.groupBy("m").agg(F.count(F.lit(1)).alias("v")).collect()}
    out = []
    for m, (key, kind) in enumerate(specs):
        totals = {r["label"]: r["n"] for r in by if r["m"] == m}
        out.append(CountModel(key, kind, list(classes), priors, [totals.get(c, 0) for c in classes], features.get(m, 0),
                              dense.where(F.col("m") == m).select("f", "c"), [output_label(task, c) for c in classes], task))
    return out


def task_specs(task: str, keys: list | None = None) -> list[tuple[str, str]]:
    return [(key, "word" if kind == "word" else "gram") for t, key, _d, kind in REGISTRY if t == task and (keys is None or key in keys)]


def task_counts(spark: SparkSession, sf_dir: str, task: str, keys: list | None = None, cleaned_docs: DataFrame | None = None) -> DataFrame:
    """MDL3, MDL4: feature counts of every (selected) model of a task in one pass over its corpus."""
    corpus = task_corpus(spark, sf_dir, task, cleaned_docs)
    mt = T.normalize_text(F.col("cleaned"), False) if cleaned_docs is not None else model_text(F.col("text"), False)
    corpus = corpus.select("label", mt.alias("mt"))
    return count_features(corpus, "label", [(kind, T.word_tokens("mt") if kind == "word" else F.col("mt")) for _k, kind in task_specs(task, keys)])


def train_task_models(spark: SparkSession, sf_dir: str, task: str, keys: list | None = None,
                      cleaned_docs: DataFrame | None = None, counts: DataFrame | None = None) -> list[CountModel]:
    """The models of a task, from its whole corpus or from ``counts`` that were kept (CountTable.totals())."""
    counts = counts if counts is not None else task_counts(spark, sf_dir, task, keys, cleaned_docs)
    return models_from_counts(counts, task_specs(task, keys), TASK_CLASSES[task], task)


def _text_counts(rows: DataFrame, kind: str) -> DataFrame:
    """(_rid, x) -> (_rid, f, n): distinct features of each text."""
    def run(batches):
        import numpy as np

        from verba.functions import grams as G

        for batch in batches:
            rid, x = batch.column("_rid").to_numpy(zero_copy_only=False), batch.column("x")
            parts = G.tokens(x) if kind == "word" else ((*np.unique(keys, return_inverse=True), owner) for keys, owner in G.grams(x))
            for names, index, owner in parts:
                if not len(owner):
                    continue
                both, n = np.unique(owner.astype(np.int64) * len(names) + index, return_counts=True)
                at = both % len(names)
                f = [names[k] for k in at.tolist()] if kind == "word" else G.unpacked(names[at])
                yield pa.RecordBatch.from_arrays([pa.array(rid[both // len(names)]), pa.array(f, pa.string()), pa.array(n)], names=["_rid", "f", "n"])

    return rows.mapInArrow(run, "_rid long, f string, n long")


def _joined_sums(rows: DataFrame, model: CountModel) -> DataFrame:
    """(_rid, x) -> (_rid, _s) for a model too large to go along: the distinct features of each text are joined
    with the weights. A common feature has one row per text; both sides are shuffled plainly, so adaptive
    execution splits its rows. Sums are combined before they are shuffled."""
    k = len(model.classes)
    j = _text_counts(rows, model.kind).join(materialize(model.weights).hint("merge"), "f")
    g = j.groupBy("_rid").agg(*[F.sum(F.col("n") * F.col("w")[i]).alias(f"s{i}") for i in range(k)], F.sum("n").alias("n"))
    return g.select("_rid", F.struct(F.array(*[F.col(f"s{i}") for i in range(k)]).alias("s"), F.col("n"), F.lit(None).cast("double").alias("seconds")).alias("_s"))


def with_sums(df: DataFrame, models: list[CountModel], text) -> DataFrame:
    """``df`` with _s0, _s1, ...: each model's sums() of the column ``text``; null ``text`` has no features."""
    small = [m.packed() is not None for m in models]
    out = df.withColumn("_text", text)
    if not all(small):
        out = materialize(out.withColumn("_rid", F.monotonically_increasing_id()))
    for i, (m, fits) in enumerate(zip(models, small, strict=True)):
        if fits:
            out = out.withColumn(f"_s{i}", m.sums(F.col("_text")))
        else:
            s = _joined_sums(out.select("_rid", m.input(F.col("_text")).alias("x")), m).withColumnRenamed("_s", f"_s{i}")
            none = F.struct(F.array(*[F.lit(0.0)] * len(m.classes)).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("seconds"))
            out = out.join(s, "_rid", "left").withColumn(f"_s{i}", F.coalesce(f"_s{i}", none))
    return out.drop("_text", "_rid")


def nb_probs(model: CountModel, s: str) -> Column:
    """Class probabilities from sums(): prior + mean log weight per known feature (long texts do not saturate)."""
    n = F.col(f"{s}.n")
    logits = [F.lit(lp) + F.when(n > 0, F.col(f"{s}.s")[k] / n).otherwise(F.lit(0.0)) for k, lp in enumerate(model.log_priors)]
    return SC.softmax(F.array(*logits))


def score_nb(docs: DataFrame, models: list[CountModel], text_col: str, keep: list) -> DataFrame:
    """``keep`` columns plus ``probs_<i>`` (class probabilities at T=1) for each model i: one row per row."""
    scored = with_sums(docs, models, F.col(text_col))
    return scored.select(*keep, *[nb_probs(m, f"_s{i}").alias(f"probs_{i}") for i, m in enumerate(models)])


# ---------------------------------------------------------------- plug-in scorer (MDL12)

def score_with_plugin(docs: DataFrame, model: PluginModel, text_col: str, keep: list, temperature: float = 1.0) -> DataFrame:
    """``keep`` columns, ``scores`` (null where the scorer failed on the row's text) and ``error``."""
    scored = docs.select(*keep, model.answers(F.col(text_col)).alias("_a"))
    return scored.select(*keep, SC.rescale_probabilities("_a.probs", temperature).alias("scores"), F.col("_a.error").alias("error"))
