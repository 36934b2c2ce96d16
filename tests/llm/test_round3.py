"""Conversation trie, toxicity grammar and whitening against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from verba.llm import queries, toxicity, trie, whitening

# ---- conversation prefix trie

TURNS = "conv_id long, turn long, role string, text string, m long, d string, `i` int, S long, ends boolean"


def plain_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        inner = {q[:-1] for q in nodes if q}
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members),
                    sum(1 for q in nodes if q and q[:-1] == p), sum(1 for q in under if q not in inner),
                    sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_rows(got):
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                   r["ends_sha256"]) for r in got.collect())


def some_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in [0, 3, 7, 99, 100, 101, 105, 140, 199, 250, 251, 300, -7, -100]:
        for t in range(rng.choice([1, 2, 6, 9, 30])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes é", "", "so"])))
    rows += [(105, None, None, "first"), (105, None, "user", None), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", "same") for c in range(400, 440) for t in range(4)]  # a hot path
    return rows + [(700, 0, "user", "x" * 50_000)]


@pytest.mark.parametrize("local", [4, 1 << 14])
def test_trie_against_brute_force(spark, local):
    rows = some_turns(local)
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, True) for r in rows], TURNS).repartition(3)
    got = trie.forked_trie(df, local=local)
    assert trie_rows(got) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert trie.forked_trie(spark.createDataFrame([], TURNS)).count() == 0
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)  # its turns are all replaced by an absent head
    rows = [(c, 0, "user", "gone")]
    got = trie.forked_trie(spark.createDataFrame([(*r, 1, "x", 2, 3, True) for r in rows], TURNS))
    assert trie_rows(got) == plain_trie(rows) and got.count() == 1


def test_trie_query_on_given_table(spark, sf):
    rows = [tuple(r) for r in pd.read_parquet(f"{sf}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    assert trie_rows(queries.op11_conversation_prefix_trie(spark, sf)) == plain_trie(rows)


def test_centroid_rollup_on_random_forests():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        for spread in (1, 5, n):  # paths, slim trees, stars
            parent = np.array([-1 if k == 0 or rng.random() < 0.01 else rng.integers(max(0, k - spread), k) for k in range(n)])
            own, values = rng.integers(1, 9, n), rng.integers(-5, 9, (n, 2))
            weight, want = own.copy(), values.copy()
            for k in range(n - 1, -1, -1):
                if parent[k] >= 0:
                    weight[parent[k]] += weight[k]
                    want[parent[k]] += want[k]
            order = rng.permutation(n)
            back = np.argsort(order)
            shuffled = np.where(parent[order] >= 0, back[parent[order]], -1)
            assert (trie.centroid_rollup(shuffled, weight[order], values[order]) == want[order]).all()


# ---- whitening

def plain_whitening(vectors, parts=32):
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1000000
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:parts], v[:, ::-1][:, :parts]
    return x, c @ v / np.sqrt(e), e / np.trace(c.T @ c / n), ((n * x.astype(object) - total) ** 2).sum(axis=1)


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 40)) * np.geomspace(3, 0.2, 40)
    rows = [(k, base[k % 400].tolist()) for k in range(600)]
    bad = [(900, None), (901, [1.0] * 39 + [float("nan")]), (902, [None] * 40), (903, []), (904, [float("inf")] * 40), (905, [1e30] * 40)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + bad], "vec_id long, embedding array<double>, _x string, n int, component int").repartition(7)
    got = whitening.whiten(df).toPandas()
    x, w, share, dev = plain_whitening([r[1] for r in rows])
    assert len(got) == 600 * 32 and set(got["n"]) == {600}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(table) - np.abs(w)).max() < 1e-8
    assert (np.abs((table * w).sum(axis=0)) > 0.999 * (w * w).sum(axis=0)).all()  # one sign for all rows
    one = got[got["component"] == 1].sort_values("vec_id")
    assert one["deviation"].tolist() == dev.tolist()
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-9)


def test_whitening_edge_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0  # no variance
    same = spark.createDataFrame([(k, [0.5, 0.25]) for k in range(5)], schema)
    assert whitening.whiten(same).count() == 0
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((50, 3)), rng.standard_normal((60, 5))
    a[:, 2] = 0.0  # a dimension without variance
    rows = [(k if k % 9 else None, v.tolist()) for k, v in enumerate([*a, *b])] + [(7, a[7].tolist())] * 2
    got = whitening.whiten(spark.createDataFrame(rows, schema).repartition(3)).toPandas()
    assert len(got) == 52 * 2 + 60 * 5 and got["identity_error"].max() < 1e-10
    large = spark.createDataFrame([(k, [float(1 << 50) * k, float(k % 3)]) for k in range(40)], schema)
    got = whitening.whiten(large).toPandas()
    assert got["deviation"].isna().all() and got["identity_error"].max() < 1e-4


@pytest.mark.parametrize("make", ["random", "graded", "clustered", "rank", "split"])
def test_right_vectors(make):
    rng = np.random.default_rng(5)
    n = 40
    r = np.linalg.qr(rng.standard_normal((200, n)), mode="r")
    if make == "graded":
        r = r * np.geomspace(1e4, 1e-4, n)
    if make == "clustered":
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        r = np.linalg.qr((q * np.r_[np.full(10, 5.0), 3 + 1e-11 * np.arange(10), np.linspace(1, 2, 20)]) @ np.linalg.qr(rng.standard_normal((n, n)))[0], mode="r")
    if make == "rank":
        r[:, 7] = r[:, 3] * 2
        r[:, 9] = 0
        r = np.linalg.qr(r, mode="r")
    if make == "split":
        r = np.diag(np.repeat(np.arange(1.0, 11.0), 4))
    lam, v = whitening.right_vectors(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(lam, want, rtol=1e-11, atol=1e-12 * want[0])
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-8 or make == "rank"
    keep = want > 1e-12 * want[0]
    assert np.abs(r.T @ (r @ v[:, keep]) - v[:, keep] * lam[keep]).max() < 1e-12 * want[0]
    assert np.abs(v[:, keep].T @ v[:, keep] - np.eye(keep.sum())).max() < 1e-8


def test_dqds_keeps_small_values_accurate():
    """Kahan-like bidiagonal: the least singular value is known from the inverse's entries."""
    a, b = np.array([1.0, 1e-4, 1e-9, 1e-3, 2.0]), np.array([1.0, 1.0, 1e-5, 1.0])
    lam = whitening.dqds(a, b)
    assert np.isclose(np.prod(np.sqrt(lam)), np.prod(a), rtol=1e-12)
    assert np.allclose(lam[:3], np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)[:3] ** 2, rtol=1e-10)


def test_whitening_query_on_given_table(spark, sf):
    got = queries.op13_embedding_whitening(spark, sf).toPandas()
    vec = pd.read_parquet(f"{sf}/embeddings.parquet")
    _, w, share, dev = plain_whitening(np.stack(vec["embedding"]))
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[vec["vec_id"]].to_numpy()
    assert np.abs(np.abs(table) - np.abs(w)).max() < 1e-6
    assert got["identity_error"].max() < 1e-9 and np.allclose(got.groupby("component")["explained"].first(), share)
    assert got[got["component"] == 1].set_index("vec_id")["deviation"].loc[vec["vec_id"]].tolist() == dev.tolist()


# ---- toxicity

LEX = {"=moron": 3.0, "idio": 3.0}


def sums(text):
    got = toxicity.text_sums(text, LEX, toxicity._tools(LEX))
    return [round(float(np.expm1(x)), 6) for x in got[:-1]]


def test_grammar_reads_clauses():
    assert sums("nice day") == [0, 0, 0, 0, 0] == sums("")
    assert sums("a moron came") == [3, 0, 0, 0, 0]
    assert sums("you are a moron") == [3, 3, 0, 0, 0]  # aimed
    assert sums("moron, you left") == [3, 0, 0, 0, 0]  # the target is in another clause
    assert sums("you are not a moron") == [3, 3, 3, 0, 0]
    assert sums("a moron is not here") == [3, 0, 0, 0, 0]  # denied is what follows the negation
    assert sums("not here. a moron") == [3, 0, 0, 0, 0]
    assert sums("she said, a moron came. A moron") == [6, 0, 0, 3, 0]  # reported up to the stop
    assert sums('he wrote "go on. moron" and left. moron') == [6, 0, 0, 3, 0]
    assert sums("I will kill you") == [2, 2, 0, 0, 2]
    assert sums("I will kill time") == [0, 0, 0, 0, 0] == sums("kill you")
    assert sums("IDIOTEN! morons") == [3, 0, 0, 0, 0]  # a stem; a whole word
    assert sums("xidiot demoron") == [0, 0, 0, 0, 0]
    assert sums("moron " * 1000 + "." + " fine day" * 50_000 + ". moron") == [3003, 0, 0, 0, 0]


def test_composition_is_the_product():
    table, states, number = toxicity.compose(toxicity.PARTS)
    rng = random.Random(6)
    for _ in range(300):
        at = {n: p[0] for n, p in toxicity.PARTS.items()}
        state = 0
        for _ in range(rng.randint(1, 12)):
            x = rng.randrange(len(toxicity.SYMBOLS))
            state = table[state][x]
            at = {n: toxicity.PARTS[n][1][s][x] for n, s in at.items()}
        assert states[state] == at
    assert len(states) == len(number)


def auc(score, y):
    order = pd.Series(score).rank()
    a, b = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - a * (a + 1) / 2) / (a * b)


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, d).toPandas()
    assert len(got) == len(pd.read_parquet(f"{d}/documents.parquet", columns=["doc_id"]))
    m = got.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    m = m[m["held_out"]].reset_index(drop=True)
    assert (m["held_out"] == m["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    print("AUC", auc(m["score"], m["toxic"]), pd.crosstab(m["toxic"], m["predicted"]))
    assert auc(m["score"], m["toxic"]) > 0.9
    assert (m["predicted"] == m["toxic"]).mean() > 0.93
    assert m[m["toxic"] == 0]["predicted"].mean() < 0.01


def test_toxicity_edge_rows(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(edge_docs, none).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.score_toxicity(no_docs, none).count() == 0
    rows = [(k, ("you utter blarg " if k % 3 == 0 else "a fine day ") + f"w{k} x{k}") for k in range(300)] + [(0, "you utter blarg"), (None, "blarg blarg")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(5, 1, None), (None, 1, 1), (6, 1, 1), (6, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 302 and all(r["predicted"] == int(r["doc_id"] is None or r["doc_id"] % 3 == 0) for r in got)


# ---- looks of texts

def plain_looks(t):
    from verba.llm import looks as K

    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    key = [w.strip(K.ENDS).lower() for w in words]
    lines = [x.lower() for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    w, chars, log = max(1, len(words)), max(1, len(t)), np.log1p(len(words))
    count = lambda f: sum(map(f, t))
    v = len(set(key)) / w
    return [count(str.isupper) / chars, count(K.SYMBOLS.__contains__) / w, t.count("!") / w, count(str.isdecimal) / chars, chars / w, v, log, v * log,
            sum(a == b for a, b in zip(key, key[1:])) / w, (len(lines) - len(set(lines))) / max(1, len(lines)), count(K.MARKS.__contains__) / w]


@pytest.mark.parametrize("size", [1 << 22, 40])
def test_looks_against_a_plain_reading(monkeypatch, size):
    import pyarrow as pa

    from verba.llm import looks as K

    monkeypatch.setattr(K, "CHUNK", size)
    rng = random.Random(9)
    texts = [None, "", " ", "\n\n", "a", "A!", "!!", "...", "a\nb\na\n", "x X x. X!", "\na", "end\n"]
    texts += ["".join(rng.choice("abAB .,!\n\t$9éÉ日") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    x, words, many = K.looks(pa.array(texts), K.tables(), 1 << 18)
    assert np.allclose(x, [plain_looks(t) for t in texts])
    assert many.tolist() == [len({w.strip(K.ENDS).lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}) for t in texts]
    again, same, _ = K.looks(pa.array(["b, A c", "a B. c"]), K.tables(), 1 << 18)
    assert set(same[:3]) == set(same[3:])
    assert K.looks(pa.array([], pa.string()), K.tables(), 8)[0].shape == (0, K.N_LOOKS)
