"""Counting and scoring kernels, mergeable counts, plug-ins that fail, topics from texts, translation memory."""

import math
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verba.functions import grams as G
from verba.operators import counts as K
from verba.operators import language as L
from verba.operators import models as M
from verba.operators import topics as TP
from verba.operators.memory import TranslationMemory
from verba.operators.plugins import PluginModel, isolated, probabilities
from verba.operators.registry import TOPIC_LABELS
from verba.plans import classify as C
from verba.sources import tables as TB
from verba.sources.commits import CommittedTable
from verba.sources.io import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
TEXTS = ["", None, "ab", "abc", "é😀x\u0000y", "aaaa", "naïve 日本語 text", "x" * 50]


@pytest.mark.parametrize("size", [1 << 22, 7])
def test_gram_kernel_against_slices(monkeypatch, size):
    monkeypatch.setattr(G, "WINDOWS", size)
    monkeypatch.setattr(G, "ROWS_BYTES", size)
    for texts in (pa.array(TEXTS), pa.array(["skipped", *TEXTS])[1:], pa.array([None, None], pa.string()), pa.array([], pa.string())):
        got = Counter()
        for keys, owner in G.grams(texts):
            got.update(zip(owner.tolist(), G.unpacked(keys), strict=True))
            assert (G.packed(G.unpacked(keys)) == keys).all()
        want = Counter((r, t[k: k + 3]) for r, t in enumerate(texts.to_pylist()) if t for k in range(len(t) - 2))
        assert got == want


def test_gram_index_finds_whole_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    index = G.GramIndex(keys)
    query = np.concatenate([keys, keys ^ 1, rng.integers(0, 1 << 62, 500)])
    at = index.find(query)
    known = np.isin(query, keys)
    assert ((at >= 0) == known).all() and (index.keys[at[known]] == query[known]).all()


def plain_scores(docs, query):
    """Naive Bayes over trigrams of the padded text, by hand: (label, text) -> scores per class of a query."""
    grams = lambda t: [p[k: k + 3] for p in [f" {t.lower()} "] for k in range(len(p) - 2)]
    classes = sorted({lab for lab, _ in docs})
    c = {lab: Counter(g for x, t in docs if x == lab for g in grams(t)) for lab in classes}
    vocab = set().union(*c.values())
    n = Counter(lab for lab, _ in docs)
    return [math.log((n[x] + 1) / (len(docs) + len(classes))) + sum(
        math.log((c[x][g] + 1) / (sum(c[x].values()) + len(vocab))) for g in grams(query) if g in vocab) for x in classes]


CORPUS = [("de", "ein kleines haus am see"), ("de", "der hund und die katze"), ("en", "a little house by the lake"), ("en", "the dog"), ("fr", "le chien"),
          (None, "nobody's words")]


@pytest.mark.parametrize("limit", [1 << 27, 0])
def test_language_scores_by_hand_with_and_without_a_join(spark, monkeypatch, limit):
    monkeypatch.setattr(M, "MODEL_MAX_BYTES", limit)
    counts = K.count_features(spark.createDataFrame(CORPUS, "lang string, t string").repartition(3), "lang", L.profile_features("t"))
    model = L.profiles_from_counts(counts)
    assert model.classes == ["de", "en", "fr"] and (model.packed() is None) == (limit == 0)
    asked = ["the house", "hund", "", None, "zzz", "the house"]
    got = L.score_languages(spark.createDataFrame(list(enumerate(asked)), "i int, t string"), model, "t", ["i"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (limit == 0)  # a projection of the scan, or a join
    rows = {r.i: r for r in got.collect()}
    assert len(rows) == len(asked)
    for i, t in enumerate(asked):
        want = plain_scores([x for x in CORPUS if x[0]], t or "")
        if t is None:
            assert rows[i].detected is None and rows[i].n_grams == 0
            continue
        assert np.allclose(rows[i].lang_scores, want), t
        assert rows[i].detected == (model.classes[int(np.argmax(want))] if rows[i].n_grams else None)


def test_counts_of_parts_add_up(spark):
    corpus = spark.createDataFrame([(k, f"c{k % 3}", f"word{k % 7} some text {k}") for k in range(200)], "i int, label string, t string")
    features = [("word", F.split("t", " ")), ("gram", F.col("t"))]
    whole = {tuple(r) for r in K.count_features(corpus, "label", features).collect()}
    table = K.CountTable(spark, scratch_path(spark, "counts"))
    table.add(K.count_features(corpus.where("i < 120"), "label", features), "a")
    table.add(K.count_features(corpus.where("i >= 100"), "label", features), "b")  # a batch that went wrong
    table.add(K.count_features(corpus.where("i >= 120"), "label", features), "b")  # replaces itself
    assert {tuple(r) for r in table.totals().collect()} == whole
    plain = Counter()
    for r in corpus.collect():
        plain[-1, r.label, None] += 1
        plain.update((0, r.label, w) for w in r.t.split(" "))
        plain.update((1, r.label, r.t[k: k + 3]) for k in range(len(r.t) - 2))
    assert whole == {(*k, n) for k, n in plain.items()}


def test_halves_give_the_whole_models_weights(spark, sf):
    docs = TB.cleaned_documents(spark, sf)
    table = K.CountTable(spark, scratch_path(spark, "counts"))
    for b in (0, 1):
        table.add(M.task_counts(spark, sf, "spam", cleaned_docs=docs.where(F.col("doc_id") % 2 == b)), f"half{b}")
    for a, b in zip(M.train_task_models(spark, sf, "spam", cleaned_docs=docs), M.train_task_models(spark, sf, "spam", counts=table.totals()), strict=True):
        assert {(r.f, *r.w) for r in a.weights.collect()} == {(r.f, *r.w) for r in b.weights.collect()} and a.log_priors == b.log_priors


def test_any_number_of_languages(spark):
    n = 1200
    docs = spark.range(n).select(F.concat(F.lit("l"), "id").alias("lang"), F.concat(F.lit("wort"), F.col("id") * 7919, F.lit(" text")).alias("text"))
    model = L.train_language_profiles(docs)
    assert len(model.classes) == n
    assert L.train_language_profiles(docs.limit(0)).classes == []


# ---- plug-ins

def test_halving_isolates_the_texts_that_fail():
    calls = []

    def call(texts):
        calls.append(len(texts))
        if any(t.startswith("bad") for t in texts):
            raise ValueError("no " + next(t for t in texts if t.startswith("bad")))
        return [[0.25, 0.75] for _ in texts]

    texts = [f"t{k}" for k in range(1000)]
    texts[333] = "bad one"
    got = isolated(call, texts, 64, probabilities(2))
    assert [k for k, (p, _) in enumerate(got) if p is None] == [333] and got[333][1] == "ValueError: no bad one"
    assert len(calls) <= 16 + 2 * 6
    odd = isolated(lambda ts: [[0.5, 0.5]] * (len(ts) - ("x" in ts)), ["a", "x", "b"], 8, probabilities(2))
    assert [p is None for p, _ in odd] == [False, True, False]
    assert isolated(lambda ts: [[2.0, -1.0] for _ in ts], ["a"], 8, probabilities(2))[0][0] is None
    assert isolated(call, [], 8, probabilities(2)) == []


def failing_scorer():
    def score(texts):
        if any("needle" in t for t in texts):
            raise RuntimeError("needle")
        return [[0.1, 0.9] for _ in texts]
    return score


def no_scorer():
    raise OSError("no such model")


def test_a_scorer_that_fails_on_one_text_costs_that_row(spark, sf):
    rows = [(k, f"hello number {k} my friend") for k in range(1000)] + [(1000, "a needle in it"), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("code", F.lit("en")).repartition(3)
    plugs = [PluginModel("own", ["not_spam", "spam"], failing_scorer), PluginModel("gone", ["not_spam", "spam"], no_scorer)]
    got = {r.doc_id: r for r in C.classify_table(spark, sf, docs, selection=["own", "gone"], models=[], plugins=plugs, language_col="code").collect()}
    assert len(got) == 1002
    good = got[7]
    assert good.prediction == "spam" and good.models_answered == ["own"] and good.models_used == ["own", "gone"]
    assert not good.is_ensemble and good.individual_results is None and good.error == "gone: OSError: no such model"
    assert good.processing_time >= 0
    assert abs(sum(good.all_scores.values()) - 1) < 1e-9
    bad = got[1000]
    assert (bad.prediction, bad.confidence, bad.all_scores, bad.models_answered) == ("unknown", 0.0, {}, [])
    assert bad.error == "own: RuntimeError: needle; gone: OSError: no such model"
    assert got[1001].prediction == "unknown" and got[1001].error == "blank text"
    assert all(r.prediction == "spam" for k, r in got.items() if k < 1000)


def test_failed_model_leaves_the_ensemble(spark, sf):
    docs = spark.createDataFrame([(1, "win a prize now"), (2, "a needle in it")], "doc_id long, text string").withColumn("code", F.lit("en"))
    models = C.load_models(spark, sf, "spam", ["roberta-sms"])
    plug = PluginModel("own", ["not_spam", "spam"], failing_scorer)
    got = {r.doc_id: r for r in C.classify_table(spark, sf, docs, selection=["roberta-sms", "own"], models=models, plugins=[plug], language_col="code").collect()}
    assert got[1].models_answered == ["roberta-sms", "own"] and got[1].is_ensemble and set(got[1].individual_results) == {"roberta-sms", "own"}
    assert got[2].models_answered == ["roberta-sms"] and not got[2].is_ensemble and got[2].prediction != "unknown"
    both = got[1].individual_results
    mean = {k: sum(m["all_scores"][k] for m in both.values()) / 2 for k in ("spam", "not_spam")}
    assert all(abs(got[1].all_scores[k] - v) < 1e-12 for k, v in mean.items())


# ---- topics

def plain_projection(words, idf, dims=TP.DIMS):
    out = np.zeros(dims)
    for b in words:
        out += TP._signs(np.array([b]))[0].astype(float) * idf[b]
    return out / np.linalg.norm(out) if np.linalg.norm(out) else out


def test_topics_against_a_plain_computation(spark, sf):
    corpus = TP.topic_corpus(spark, sf)
    model = TP.train_topics(corpus)
    train = corpus.select("label", TP.word_buckets("mt").alias("b")).collect()
    n, df = len(train), Counter(b for r in train for b in set(r.b))
    idf = {b: math.log((n + 1) / (df.get(b, 0) + 1)) + 1 for r in train for b in r.b}
    vec = [(r.label, plain_projection(r.b, idf)) for r in train]
    protos = np.stack([np.mean([v for x, v in vec if x == k], axis=0) for k in range(10)])
    assert np.allclose(protos, model.prototypes, atol=1e-6)
    docs = TB.load(spark, sf, "documents").select("doc_id", "text").withColumn("code", F.lit("en"))
    got = {r.doc_id: r for r in C.classify_table(spark, sf, docs, task="topic", models=[model], language_col="code").collect()}
    assert len(got) == docs.count()
    from verba.plans.q_models import _docs_model_text
    for r in _docs_model_text(spark, sf).select("doc_id", TP.word_buckets("mt").alias("b")).limit(40).collect():
        for b in r.b:
            idf.setdefault(b, math.log(n + 1) + 1)
        x = plain_projection(r.b, idf)
        if not x.any():
            assert got[r.doc_id].prediction == "unknown"
            continue
        cos = protos @ x / np.linalg.norm(protos, axis=1)
        dist = -((protos - x) ** 2).sum(axis=1)
        p = [np.exp(z) / np.exp(z).sum() for z in (cos, dist)]
        want = (p[0] + p[1]) / 2
        assert np.allclose([got[r.doc_id].all_scores[k] for k in TOPIC_LABELS], want, atol=1e-5)


def test_topics_learn_from_words(spark):
    rng = np.random.default_rng(3)
    words = {k: [f"t{k}w{j}" for j in range(30)] for k in range(10)}
    text = lambda k: " ".join([*rng.choice(words[k], 12), *(f"n{j}" for j in rng.integers(0, 500, 12))])
    train = spark.createDataFrame([(k % 10, text(k % 10)) for k in range(400)], "label int, mt string")
    model = TP.train_topics(train)
    asked = [(k, text(k % 10)) for k in range(100)] + [(100, ""), (101, None)]
    docs = spark.createDataFrame(asked, "doc_id long, text string").withColumn("code", F.lit("en"))
    got = {r.doc_id: r for r in C.classify_table(spark, "", docs, task="topic", models=[model], language_col="code").collect()}
    assert sum(got[k].prediction == TOPIC_LABELS[k % 10] for k in range(100)) > 95
    assert got[100].prediction == got[101].prediction == "unknown" and got[5].models_answered == ["bart-mnli", "deberta-nli"]


# ---- translations

def counting_translator():
    import os
    import tempfile

    def translate(pairs):
        if any(t == "boom" for t, _ in pairs):
            raise ValueError("boom")
        with open(os.path.join(tempfile.gettempdir(), "verba-test-calls"), "a") as f:  # one machine in tests
            f.write("".join(f"{t}\n" for t, _ in pairs))
        return ["  " if t == "blank" else t.upper() for t, _ in pairs]
    return translate


def test_a_text_is_translated_once(spark):
    import os
    import tempfile

    log = os.path.join(tempfile.gettempdir(), "verba-test-calls")
    open(log, "w").close()
    memory = TranslationMemory(spark, scratch_path(spark, "memory"))
    first = [("hallo welt", "de")] * 3 + [("boom", "de"), ("blank", "fr"), ("hello", "en"), ("was", "unknown"), (None, "de"), ("hallo welt", "fr")]
    df = spark.createDataFrame(first, "t string, lang string").repartition(4)
    got = Counter((r.t, r.lang, r.translated_text) for r in memory.translate(df, "t", "lang", counting_translator, "a").collect())
    assert got == Counter({("hallo welt", "de", "HALLO WELT"): 3, ("boom", "de", "boom"): 1, ("blank", "fr", "blank"): 1, ("hello", "en", "hello"): 1,
                           ("was", "unknown", "was"): 1, (None, "de", None): 1, ("hallo welt", "fr", "HALLO WELT"): 1})
    failed = memory.learn(spark.createDataFrame([("neu", "de"), ("hallo welt", "de"), ("boom", "de")], "t string, lang string"), "t", "lang",
                          L.route_for_translation("lang"), counting_translator, "b").collect()
    assert [r.error for r in failed] == ["ValueError: boom"]  # asked again, as it isn't remembered
    with open(log) as f:
        assert Counter(f.read().split("\n")[:-1]) == Counter({"hallo welt": 2, "blank": 1, "neu": 1})  # once per language
    assert memory.rows().count() == 4


def test_no_translations_unless_they_are_given(spark, sf):
    docs = TB.cleaned_documents(spark, sf)
    from verba.functions import text as T
    got = C.preprocess_table(spark, sf, docs, L.language_profiles(spark, sf, docs))
    want = docs.select("doc_id", T.normalize_text("cleaned").alias("w"))
    assert got.join(want, got["id"] == want["doc_id"]).where("model_text != w").count() == 0


# ---- committed appends

def test_append_survives_a_crash_before_its_commit(spark):
    table = CommittedTable(spark, scratch_path(spark, "commits"), "id long")
    assert table.read().count() == 0 and table.sweep() == 0

    def crash():
        raise RuntimeError("lost")

    assert table.append(spark.range(10), "a")
    with pytest.raises(RuntimeError, match="lost"):
        table.append(spark.range(10, 30), "b", before_commit=crash)
    assert sorted(r.id for r in table.read().collect()) == list(range(10))  # files without a record aren't read
    assert table.append(spark.range(10, 30), "b") and not table.append(spark.range(10, 30), "b")
    assert sorted(r.id for r in table.read().collect()) == list(range(30))
    assert table.sweep() == 1 and table.read().count() == 30
    with pytest.raises(ValueError):
        table.append(spark.range(1), "../x")

