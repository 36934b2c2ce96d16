"""SimHash, suffix arrays and embeddings against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import edge_items, prose
from xxhash import xxh64_intdigest

from verba.llm import suffix
from verba.llm.common import components, field, forest
from verba.llm.simhash import anchor_masks, keep_one, near_links, simhash_components
from verba.llm.suffix import remove_repeats, texts_without_repeats
from verba.llm.vectors import embedding_components, table_plan


def groups(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def simhash(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_forest_and_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400, x) for x in range(500, 700)] + [(5, 5)]
    names = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(names)}
    want = {x: names[r] for x, r in zip(names, groups(len(names), [(at[a], at[b]) for a, b in edges]), strict=True)}
    node, root = forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: r for x, r in want.items() if x != r}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in want.items() if x != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_anchors_cover(spark):
    """Each half has exactly one home, and every half within one bit of it visits that home."""
    rows = [(r["_s"], r["_mask"], r["home"]) for r in anchor_masks(spark, 2).collect()]
    assert len(rows) == 529 and Counter(s for s, _, h in rows if h) == Counter(range(32))
    from verba.llm.simhash import _syndrome
    for x in np.random.default_rng(2).integers(0, 1 << 32, 50).tolist():
        home = next(x ^ m for s, m, h in rows if h and s == _syndrome(x))
        for bit in range(32):
            y = x ^ (1 << bit)
            assert home in {y ^ m for s, m, _ in rows if s == _syndrome(y)}


def test_near_links_finds_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40).tolist()
    fps = set(base)
    for x in base:
        for _ in range(12):
            for bit in rng.integers(0, 63, rng.integers(1, 6)).tolist():
                x ^= 1 << bit
            fps.add(x)
    dense = base[0]
    fps |= {dense ^ (a << 3) ^ (b << 40) for a in range(32) for b in range(32)}
    fps = sorted(fps)
    arr = np.array(fps, dtype=np.int64).view(np.uint64)
    d = np.bitwise_count(arr[:, None] ^ arr[None, :])
    want = groups(len(fps), zip(*np.nonzero(np.triu(d <= 3, 1)), strict=True))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in components(near_links(df, 3)).collect()}
    ours = [got.get(x, x) for x in fps]
    by = {}
    assert all(by.setdefault(w, o) == o for w, o in zip(want, ours, strict=True)) and len(set(ours)) == len(set(want))
    for u, v in [(r["u"], r["v"]) for r in near_links(df, 3).collect()]:
        assert want[fps.index(u)] == want[fps.index(v)]


def test_large_anchors_are_cut(spark, monkeypatch):
    from pyspark.sql import functions as F

    from verba.llm import simhash as S

    monkeypatch.setattr(S, "ANCHOR_ROWS", 100)
    rng = np.random.default_rng(5)
    fps = sorted({int(x) << 32 | 12345 for x in rng.integers(0, 1 << 16, 1500)} | {int(x) << 32 | 12345 ^ 1 << int(x) % 5 for x in rng.integers(0, 1 << 31, 500)})
    rows = spark.createDataFrame([(7, k % 2 == 0, x) for k, x in enumerate(fps)] + [(8, True, 1), (8, False, 3)], "anchor long, home boolean, fp long")
    cut = S.in_blocks(rows)
    assert max(r["count"] for r in cut.groupBy("anchor").count().collect()) <= 2 * 150
    met = cut.where("home").alias("a").join(cut.alias("b"), "anchor").where("a.fp != b.fp").select(
        F.col("a.fp").alias("x"), F.col("b.fp").alias("y")).distinct().count()
    homes = (len(fps) + 1) // 2
    assert met == homes * (len(fps) - 1) + 1  # every home meets every other row of its anchor
    arr = np.array(fps, dtype=np.int64).view(np.uint64)
    want = groups(len(fps), zip(*np.nonzero(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3, 1)), strict=True))
    got = {r["node"]: r["root"] for r in components(near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3)).collect()}
    by = {}
    assert all(by.setdefault(w, got.get(x, x)) == got.get(x, x) for w, x in zip(want, fps, strict=True))
    assert len(set(by.values())) == len(set(want))


def test_simhash_against_brute_force(edge_docs):
    rows = edge_items()
    fp = [simhash(r[1]) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
    root = groups(len(rows), near)
    ids = {}
    for r, c in zip(rows, root, strict=True):
        ids.setdefault(c, []).append(r[0])
    want = Counter((r[0], f"{f:016x}", min((i for i in ids[c] if i is not None), default=None))
                   for r, f, c in zip(rows, fp, root, strict=True))
    got = simhash_components(edge_docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    one = keep_one(edge_docs)
    assert one.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in one.collect()) == sorted(
        str(min((i for i in v if i is not None), default=None)) for v in ids.values())


def repeats(texts, size):
    seen = Counter(t[p: p + size] for t in texts for p in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if seen[t[p: p + size]] > 1:
                gone[p: p + size] = b"\1" * size
        runs = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((bytes(x for x, g in zip(t, gone, strict=True) if not g), sum(gone), runs))
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeats_against_brute_force(spark, edge_docs, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)  # 2: the way for grams with very many contexts
    items = [r for r in edge_items() if len(r[1] or "") < 10_000]
    texts = [(t or "").encode() for _, t, _, _ in items]
    period, passage = b"abcab" * 120, prose("passage", 70).encode()
    texts += [period, passage[:250], b"q" + passage[30:260] + b"z" + passage[:205], passage[:199], "ü".encode() * 300, b"\n" * 450]
    texts += [prose(k, 30).encode() + passage[:210 + k] + prose(-k, 30).encode() for k in range(30)]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["i"]: (bytes(r["kept"]), r["n_removed"] or 0, r["n_spans"] or 0)
           for r in remove_repeats(df).select(field("doc_id").alias("i"), "kept", "n_removed", "n_spans").collect()}
    assert [got[k] for k in range(len(texts))] == repeats(texts, 200)


def test_long_texts_in_pieces():
    """Entries of a text that is hashed in pieces cover the same windows as the whole."""
    text = prose("pieces", 90_000).encode()
    assert len(text) > suffix.PIECE
    doc, anchor, block, d, n, at = suffix._entries([b"", text, b"short", text[1000:]], 200)
    for k, size in ((1, len(text)), (3, len(text) - 1000)):
        own = doc == k
        covered = np.zeros(size - 199, dtype=int)
        for a, c in zip(at[own], n[own], strict=True):
            covered[a: a + c + 1] += 1
        assert (covered == 1).all()
    assert set(doc.tolist()) == {1, 3} and (d >= 0).all() and (d <= 168).all()
    assert len(set(anchor[doc == 3]) - set(anchor[doc == 1])) <= 2


def test_repeats_on_edge_rows(edge_docs, no_docs):
    out = texts_without_repeats(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    rows = out.collect()
    assert all(r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"]) for r in rows)
    assert all(r["text"] == "" for r in rows if r["doc_id"] in (30, 31))
    assert next(r for r in rows if r["doc_id"] == 23)["text"] == prose("long", 60_000)
    assert remove_repeats(no_docs).count() == 0


def test_empty_tables(spark, no_docs):
    assert simhash_components(no_docs).count() == 0 and keep_one(no_docs).count() == 0
    assert embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((30, 16))
    rows = [(k, (centre[k % 30] + 0.15 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(900)]
    hot = centre[0] * 3
    rows += [(k, (hot + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(1000, 1700)]
    rows += [(2000 + k, rows[5][1]) for k in range(50)] + [rows[7], rows[7]]
    bad = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [None] + [1.0] * 15),
           (3005, [float("inf")] + [1.0] * 15), (None, None), (None, rows[9][1])]
    rows = rows + bad
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[k][1] for k in ok], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    root = groups(len(ok), zip(*np.nonzero(np.triu(link, 1)), strict=True))
    low = {}
    for k, c in zip(ok, root, strict=True):
        if rows[k][0] is not None:
            low[c] = min(low.get(c, 1 << 60), rows[k][0])
    want = Counter((rows[k][0], int(n), low.get(c)) for k, n, c in zip(ok, link.sum(axis=1), root, strict=True))
    want += Counter((rows[k][0], 0, rows[k][0]) for k in set(range(len(rows))) - set(ok))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_components(df).collect())
    lost = sum((want - got).values())
    assert sum(got.values()) == len(rows) and lost <= 0.001 * len(rows)  # MISS: 1 in 10,000 at the threshold


def test_embeddings_of_mixed_lengths(spark):
    rng = np.random.default_rng(8)
    rows = []
    for size, n in ((1, 40), (3, 300), (8, 200), (64, 200)):
        centres = rng.standard_normal((n // 10, size))
        rows += [(centres[k % len(centres)] + 0.1 * rng.standard_normal(size)).tolist() for k in range(n)]
    rows += [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0], [1.0] + [0.0] * 63]  # alike but for their length
    unit = [np.array(v) / np.linalg.norm(v) for v in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if len(rows[a]) == len(rows[b]) and unit[a] @ unit[b] >= 0.95]
    links, want = Counter(x for e in linked for x in e), groups(len(rows), linked)
    got = {r["vec_id"]: r for r in embedding_components(
        spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert len(got) == len(rows) and sum(got[k]["n_links"] for k in got) >= 0.999 * 2 * len(linked)
    assert all(got[k]["n_links"] <= links[k] for k in got)
    assert {k: r["component_id"] for k, r in got.items()} == dict(enumerate(want))


def test_table_plan_holds_recall():
    for n in (0, 1, 100, 10_000, 10_000_000):
        bits, tables = table_plan(n, 0.95)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 1e-4


def test_levels_are_merged_in_order_without_a_shuffle(spark):
    index, rng, seen = suffix.SuffixIndex(spark), np.random.default_rng(4), Counter()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in range(7):
            heads = rng.integers(0, 400, 90)
            path = suffix.shared_path(spark, "array")
            array = suffix.written(spark.createDataFrame([(int(h),) for h in heads], "anchor long"), "array", path)
            hits = {r["anchor"] for r in index.insert(array, path, suffix.shared_path(spark, "hits")).collect()}
            new = Counter(heads.tolist())
            assert hits == {h for h, n in new.items() if n > 1 or h in seen}
            seen += new
            sizes = [level[0] for level in index.levels]
            assert sum(sizes) == k + 1 and sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
        total = Counter()
        for level in index.levels:
            total.update({r["anchor"]: r["n"] for r in spark.table(level[1]).collect()})
        assert total == seen and index.suffixes().count() == sum(seen.values())
        plan = suffix.merged_heads(spark.table(index.levels[0][1]), spark.table(index.levels[1][1]))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        index.drop()
        assert not spark.catalog.listTables(pattern="heads_*")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_common_runs_and_their_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_RUN", 3)
    line, tail = prose("line", 90), prose("tail", 80)
    rows = [(k, prose(k, 20) + " " + line + (" " + tail if k % 3 == 0 else "") + " " + prose(-k, 9)) for k in range(60)]
    rows += [(100, tail), (101, "é" * 300), (102, "é" * 300), (102, "é" * 300)]
    texts = [t.encode() for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["i"], bytes(r["kept"])) for r in remove_repeats(df).select(field("doc_id").alias("i"), "kept").collect())
    assert got == Counter((i, kept) for (i, _), (kept, _, _) in zip(rows, repeats(texts, 200), strict=True))


def test_kept_digest_is_of_the_remaining_bytes(spark):
    text = prose("d", 100)
    df = spark.createDataFrame([(1, text), (2, text + " tail"), (3, "other")], "doc_id long, text string")
    rows = {r["i"]: r["kept"] for r in remove_repeats(df).select(field("doc_id").alias("i"), "kept").collect()}
    assert hashlib.sha256(rows[3]).hexdigest() == hashlib.sha256(b"other").hexdigest()
    assert bytes(rows[1]) == b"" and bytes(rows[2]) == b" tail"
