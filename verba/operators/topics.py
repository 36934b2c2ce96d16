"""Topics (MDL7, MDL11): prototypes of vectors, and of texts as IDF-weighted, randomly projected words."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.functions import scores as SC
from verba.functions import text as T
from verba.operators.registry import REGISTRY, TOPIC_LABELS
from verba.session import materialize
from verba.sources.tables import load

BUCKETS = 1 << 18  # of a word's hash: the table of document frequencies has this size for any vocabulary
DIMS = 256  # of the projection
PAIR = "struct<probs_0 array<double>, probs_1 array<double>>"


def topic_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, dim, p): mean vector of each label. Size: labels x dims."""
    ex = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return ex.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("p"))


def prototype_matrix(protos: DataFrame):
    """Rows in TOPIC_LABELS order (labels x dims numbers reach the driver); a label without one is a row of NaN."""
    import numpy as np

    rows = protos.where(F.col("label").between(0, len(TOPIC_LABELS) - 1)).collect()
    out = np.full((len(TOPIC_LABELS), max([r["dim"] for r in rows], default=-1) + 1), np.nan)
    for r in rows:
        out[r["label"], r["dim"]] = r["p"]
    return out


def _softmax(x):
    import numpy as np

    e = np.exp(x - np.nanmax(x, axis=1, keepdims=True))
    return e / np.nansum(e, axis=1, keepdims=True)


def _likeness(x, protos):
    """Softmax of cosines and of negative squared distances to the prototypes; a vector without a direction
    has no cosines (NaN), a label without a prototype no share."""
    import numpy as np

    with np.errstate(all="ignore"):
        known = ~np.isnan(protos).any(axis=1)
        p = protos[known]
        dot, xx, pp = x @ p.T, (x * x).sum(axis=1)[:, None], (p * p).sum(axis=1)[None, :]
        out = []
        for one in (dot / (np.sqrt(xx) * np.sqrt(pp)), 2 * dot - xx - pp):
            probs = np.zeros((len(x), len(protos)))
            probs[:, known] = _softmax(one) if known.any() else 0.0
            out.append(probs)
        return out


def _struct(pair, missing):

    def lists(p):
        return pa.array([None if m or not (v == v).all() else v for v, m in zip(p, missing, strict=True)], pa.list_(pa.float64()))

    return pa.StructArray.from_arrays([lists(p) for p in pair], names=["probs_0", "probs_1"])


def score_topics(vectors: DataFrame, protos: DataFrame, keep: list, vec_col: str = "embedding") -> DataFrame:
    """Per vector: cosine to each prototype (model A) and negative squared distance (model B), softmaxed, as
    arrays in TOPIC_LABELS order. The prototypes go along as a small matrix: no row per dimension, no
    shuffle. A vector without a direction (null, empty, zero, of another length) keeps its row, with
    null scores where a cosine has no meaning."""

    matrix = prototype_matrix(protos)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        dims = matrix.shape[1]
        for v in batches:
            size = np.asarray(pc.fill_null(pc.list_value_length(v), 0))
            good = size == dims
            x = np.zeros((len(v), dims))
            if good.any() and dims:
                x[good] = np.asarray(v.filter(pa.array(good)).flatten(), dtype=np.float64).reshape(-1, dims)
            yield _struct(_likeness(x, matrix), ~good | ~(x != 0).any(axis=1))

    scored = vectors.select(*keep, F.arrow_udf(run, PAIR)(F.col(vec_col).cast("array<double>")).alias("_s"))
    return scored.select(*keep, "_s.probs_0", "_s.probs_1")


# ---------------------------------------------------------------- from texts

def word_buckets(model_text) -> Column:
    """Buckets of a text's words, one for each occurrence."""
    return F.transform(T.word_tokens(model_text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _signs(buckets):
    """Rows of +1 and -1 that follow from the bucket alone: the random projection, never stored."""
    import numpy as np

    z = buckets.astype(np.uint64)[:, None] * np.uint64(DIMS // 64) + np.arange(DIMS // 64, dtype=np.uint64) + np.uint64(1)
    z = z * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    z = z ^ z >> np.uint64(31)
    bits = np.unpackbits(z.view(np.uint8).reshape(len(buckets), -1), axis=1)
    return bits.astype(np.float64) * 2 - 1


def project(lists, idf):
    """Arrow lists of buckets -> unit vectors: sums of term count x IDF x signs. Texts without words: zero."""
    import numpy as np

    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    flat, end = np.asarray(lists.flatten()).astype(np.int64), np.cumsum(size)
    out = np.zeros((len(size), DIMS))
    lo = 0
    while lo < len(size):  # rows at once: up to 256 with 16,384 words, or one text
        hi = min(max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + (1 << 14), side="right"))), lo + 256)
        b = flat[end[lo] - size[lo]: end[hi - 1]]
        row = np.repeat(np.arange(hi - lo), size[lo:hi])
        for k in range(0, len(b), 1 << 14):
            words, at = np.unique(b[k: k + (1 << 14)], return_inverse=True)
            own = row[k: k + (1 << 14)]
            counts = np.bincount(own * len(words) + at, minlength=(hi - lo) * len(words)).reshape(hi - lo, len(words))
            out[lo:hi] += (counts * idf[words]) @ _signs(words)
        lo = hi
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


@dataclass
class TopicModel:
    """Document frequencies of word buckets, as weights, and a prototype per topic."""

    idf: object
    prototypes: object
    keys: tuple = tuple(k for t, k, _d, _kind in REGISTRY if t == "topic")

    def pairs(self, model_text) -> Column:
        """Struct of both models' probabilities; texts without words have none."""

        idf, protos = self.idf, self.prototypes

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                x = project(lists, idf)
                yield _struct(_likeness(x, protos), ~(x != 0).any(axis=1))

        return F.arrow_udf(run, PAIR)(word_buckets(model_text))


def topic_corpus(spark: SparkSession, sf_dir: str, cleaned_docs: DataFrame | None = None) -> DataFrame:
    """(label, mt): texts with a topic, by embeddings of the same id (FIXTURES §3)."""
    lab = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    docs = cleaned_docs if cleaned_docs is not None else load(spark, sf_dir, "documents")
    text = T.normalize_text("cleaned" if cleaned_docs is not None else T.clean_text("text"), False)
    return docs.select("doc_id", text.alias("mt")).join(lab, "doc_id").select("label", "mt")


def train_topics(corpus: DataFrame) -> TopicModel:
    """Prototypes from labelled texts (label 0.., mt): IDF = ln((texts + 1) / (texts of the bucket + 1)) + 1;
    a prototype is the mean of its texts' unit vectors, summed up per task. What reaches the driver has a
    fixed size: BUCKETS counts and labels x DIMS sums."""
    import numpy as np

    rows = materialize(corpus.where(F.col("label").between(0, len(TOPIC_LABELS) - 1)).select("label", word_buckets("mt").alias("b")))
    n = rows.count()
    idf = np.full(BUCKETS, np.log(n + 1.0) + 1.0)
    df = rows.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    idf[np.asarray(df["b"])] = np.log((n + 1.0) / (np.asarray(df["n"]) + 1.0)) + 1.0

    def run(batches, idf=idf):
        for batch in batches:
            x, label = project(batch.column("b"), idf), np.asarray(batch.column("label"))
            found = np.unique(label)
            sums = np.stack([x[label == k].sum(axis=0) for k in found]) if len(found) else np.zeros((0, DIMS))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(found, DIMS), pa.int32()), pa.array(np.tile(np.arange(DIMS), len(found)), pa.int32()), pa.array(sums.ravel(), pa.float64()),
                pa.array(np.repeat([(label == k).sum() for k in found], DIMS), pa.int64())], names=["label", "dim", "s", "n"])

    sums = rows.mapInArrow(run, "label int, dim int, s double, n long").groupBy("label", "dim").agg((F.sum("s") / F.sum("n")).alias("p"))
    return TopicModel(idf, prototype_matrix(sums))


def topic_scores(pair_col: str, k: int, t: float) -> Column:
    return SC.rescale_probabilities(F.col(f"{pair_col}.probs_{k}"), t)
