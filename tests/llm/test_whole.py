"""The pipeline against a plain reading of its stages, the kept suffix index, shard directories, scratch files."""

import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F
from test_dedup import groups, repeats, simhash

import corpus_pipeline as P
from verba.llm import common, queries, sharding, suffix
from verba.llm.common import components, field, scratch, shared_path, written

# ---- pipeline


def planted(docs):
    """Rows of documents, and near copies, repeated rows, shared passages, null and empty texts among them."""
    rows, cols = [r.asDict() for r in docs.orderBy("doc_id").collect()], docs.columns
    top, passage = max(r["doc_id"] for r in rows) + 1, prose("shared by many", 90)
    clean = [r for r in rows if len(r["text"].split()) > 60][:8]
    new = [dict(r, doc_id=top + k, text=r["text"] + " more") for k, r in enumerate(clean[:3])]
    new += [dict(r, doc_id=top + 10 + k, text=f"{r['text'][:300]} {passage} {prose(k, 70)}") for k, r in enumerate(clean[3:])]
    new += [dict(clean[0], doc_id=top + 20), dict(clean[0], doc_id=top + 20)]
    new += [dict(clean[1], doc_id=top + 30, text=None, n_chars=None), dict(clean[1], doc_id=top + 31, text="", n_chars=0),
            dict(clean[2], doc_id=None, source=None, lang=None, text=prose("no id", 60))]
    for r in new:
        r["n_chars"] = None if r["text"] is None else len(r["text"])
    return [tuple(r[c] for c in cols) for r in rows + new]


def plain_stages(rows, cols):
    """Stages 2 to 4 of rows, one after the other, in plain Python and DuckDB: the rows after each."""
    at = {c: k for k, c in enumerate(cols)}
    fp = [simhash(r[at["text"]]) for r in rows]
    root = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3])
    by = defaultdict(list)
    for r, g in zip(rows, root, strict=True):
        by[g].append(r)
    one = [min(g, key=lambda r: (r[at["doc_id"]] is None, r[at["doc_id"]] or 0)) for g in by.values()]
    cut = []
    for r, (kept, gone, _) in zip(one, repeats([(r[at["text"]] or "").encode() for r in one], 200), strict=True):
        text = kept.decode("utf-8", "ignore") if gone else r[at["text"]]
        cut.append(tuple(text if c == "text" else (len(text) if c == "n_chars" and gone else v) for c, v in zip(cols, r, strict=True)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([dict(zip(cols, r, strict=True)) for r in cut]).astype({"doc_id": "Int64"}))
    copies = {(i, source): n for i, source, n in con.execute(f"SELECT doc_id, source, copies FROM ({queries.OP4_SQL})").fetchall()}
    mixed = [r for r in cut for _ in range(copies[r[at["doc_id"]], r[at["source"]]])]
    return one, cut, mixed


def test_pipeline_against_plain_stages(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    given = spark.read.parquet(f"{sf}/documents.parquet")
    cols, folder = given.columns, str(tmp_path)
    spark.createDataFrame(planted(given), given.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        docs = written(stage(spark, docs, folder), f"plain{k}")
        seen.append([tuple(r) for r in docs.collect()])
    plain = plain_stages(seen[0], cols)
    assert len(seen[0]) > len(plain[0]) > 20 and plain[1] != plain[0]
    for got, want in zip(seen[1:], plain, strict=True):
        assert Counter(got) == Counter(want)
    # packing, by run(): every copy's ids lie in gapless sequences, each once
    coder, want = Tokenizer.from_file(queries.vocabulary()), defaultdict(Counter)
    at = {c: k for k, c in enumerate(cols)}
    for r in plain[2]:
        ids = [*coder.encode(r[at["text"]] or "", add_special_tokens=False).ids, 1]
        want[r[at["doc_id"]]].update(enumerate(ids))
    got, inside = defaultdict(Counter), defaultdict(list)
    for r in P.run(spark, folder).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        got[r["doc_id"]].update(enumerate(ids, r["start"]))
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in inside.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_pipeline_of_nothing(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


# ---- files on the way


def there(path):
    return os.path.exists(path.removeprefix("file:"))


def test_scratch_files_go_and_results_stay(spark):
    kept = shared_path(spark, "kept")
    with scratch(spark):
        with scratch(spark):
            inner = shared_path(spark, "inner")
            written(spark.range(5).toDF("x"), "inner", inner)
        outer = shared_path(spark, "outer")
        got = written(written(spark.range(7).toDF("x"), "outer", outer), "kept", kept)
        assert not there(inner) and there(outer)
    assert not there(outer) and got.count() == 7
    with pytest.raises(ZeroDivisionError), scratch(spark):
        outer = shared_path(spark, "outer")
        written(spark.range(3).toDF("x"), "outer", outer)
        raise ZeroDivisionError
    assert not there(outer) and common.SCOPE.get() == ""


def test_components_of_long_paths(spark):
    """Paths of shuffled nodes, stars and a cycle: as many rounds as it takes."""
    rng, n = np.random.default_rng(8), 700
    name = rng.permutation(n).tolist()
    links = [(k, k + 1) for k in range(499)] + [(500, k) for k in range(501, 600)] + [(k, 600 + (k - 599) % 100) for k in range(600, 700)]
    root = groups(n, [(name[a], name[b]) for a, b in links])
    edges = spark.createDataFrame([(name[a], name[b]) for a, b in links], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {x: r for x, r in enumerate(root) if x != r}


# ---- kept suffix index


def index_texts():
    passage = prose("passage", 90)
    return [[(k, prose(k, 60) + (passage if k == 1 else "")) for k in range(5)] + [(5, None), (None, "")],
            [(10, prose(2, 60) + " tail"), (11, "own " + prose(11, 60)), (12, passage[:260] + prose(12, 30))],
            [],
            [(20, "own " + prose(11, 60)), (20, "own " + prose(11, 60)), (21, "ab" * 300), (0, prose(0, 60))],
            [(30, prose(30, 500)), (31, passage + passage)]]


def test_later_batches_meet_the_levels(spark, tmp_path):
    """After each batch, given to a family that is opened anew, removal is that of all batches at once."""
    schema, path = "doc_id long, text string", f"{tmp_path}/family"
    batches, so_far = index_texts(), []
    for batch in batches:
        suffix.SuffixIndex(spark, path).add(spark.createDataFrame(batch, schema).repartition(2))
        so_far += batch
        family = suffix.SuffixIndex(spark, path)
        got = Counter((r["i"], bytes(r["kept"]), r["n_removed"] or 0, r["n_spans"] or 0) for r in family.remove_repeats(
            spark.createDataFrame(so_far, schema)).select(field("doc_id").alias("i"), "kept", "n_removed", "n_spans").collect())
        assert got == Counter((i, *x) for (i, _), x in zip(so_far, repeats([(t or "").encode() for _, t in so_far], 200), strict=True))
    assert [level[0] for level in family.levels] == [4, 1]
    assert len(os.listdir(f"{path}/manifests")) == 1 and len(os.listdir(f"{path}/heads")) == 2
    family.drop()
    assert not os.path.exists(path) and not spark.catalog.listTables(pattern="heads_*")


def test_failure_before_the_commit_leaves_the_family(spark, tmp_path, monkeypatch):
    schema, path = "doc_id long, text string", f"{tmp_path}/family"
    first, second = index_texts()[0], index_texts()[1]
    suffix.SuffixIndex(spark, path).add(spark.createDataFrame(first, schema))

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(suffix.SuffixIndex, "_commit", lost)
        with pytest.raises(OSError, match="lost"):
            suffix.SuffixIndex(spark, path).add(spark.createDataFrame(second, schema))
    family = suffix.SuffixIndex(spark, path)
    assert [level[0] for level in family.levels] == [1] and len(family.found) == 1
    family.add(spark.createDataFrame(second, schema))
    both = first + second
    got = Counter(bytes(r["kept"]) for r in family.remove_repeats(spark.createDataFrame(both, schema)).collect())
    assert got == Counter(kept for kept, _, _ in repeats([(t or "").encode() for _, t in both], 200))
    family.drop()


# ---- shard directory


def plain_directory(rows, limit, depth=0, prefix=0):
    """Extendible hashing by recursion: (depth, prefix, bytes, rows) of every bucket."""
    size = sum(s for _, s in rows)
    if size <= limit or len(rows) <= 1 or depth == sharding.BITS:
        return [(depth, prefix, size, len(rows))] if rows else []
    halves = [[], []]
    for h, s in rows:
        halves[h >> (sharding.BITS - depth - 1) & 1].append((h, s))
    return [x for bit in (0, 1) for x in plain_directory(halves[bit], limit, depth + 1, 2 * prefix + bit)]


@pytest.mark.parametrize("limit", [0, 50, 900, 10**6])
def test_directory_against_plain_splitting(spark, limit):
    rng = np.random.default_rng(limit)
    rows = [(int(rng.integers(0, 1 << sharding.BITS)), int(rng.integers(0, 40))) for _ in range(400)]
    deep = int(rng.integers(0, 1 << 30)) << 30
    rows += [(deep + k, 30) for k in range(50)] + [(deep, 30)] * 3 + [(deep + (1 << 29), 4000)]
    got = sharding.shard_directory(spark.createDataFrame(rows, "h long, size long"), limit).collect()
    assert Counter((r["depth"], r["prefix"], r["shard_bytes"], r["shard_rows"]) for r in got) == Counter(plain_directory(rows, limit))


def test_sharding_query_splits(spark):
    """The registered limit splits the given documents, and each shard holds its limit."""
    rows = queries.op8_sharding(spark, "/root/testdata/sf0.01").select("shard", "n_bytes").collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["n_bytes"]
    assert len(size) > 1 and max(size.values()) <= queries.SHARD_BYTES


def test_turns_keep_other_columns(spark):
    """format_turns() adds one column and replaces one of that name; the rest stays as it is."""
    from verba.llm.chat import format_turns

    turns = spark.createDataFrame([(1, "user", "hi", "mine"), (2, None, None, None)], "turn int, role string, text string, segment string")
    out = format_turns(turns, queries.vocabulary("byte_bpe_50k.tiktoken"))
    assert out.columns == turns.columns and out.select(F.col("segment.n_chars")).count() == 2
