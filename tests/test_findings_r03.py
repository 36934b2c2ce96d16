"""Probes for the third round's findings, on rows of their own."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verba.functions import grams as G
from verba.functions import scores as SC
from verba.functions import text as T
from verba.operators import jobs as J
from verba.operators import topics as TP
from verba.session import materialize, partitions
from verba.sources import io as IO
from verba.sources.io import index_within, scratch_path
from verba.streaming import streams as ST


def test_softmax_reads_its_entries_once(spark):
    """Linear in the entries: maximum and sum are not computed anew for every entry (F1)."""
    x = [math.sin(k) * 5 for k in range(300)]
    df = spark.createDataFrame([(1, x), (2, None), (3, [])], "id int, x array<double>").select("id", SC.softmax("x", F.lit(2.0)).alias("p"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_max(") == 1 and plan.lower().count("exp(") == 1
    got = {r.id: r.p for r in df.collect()}
    e = [math.exp((v - max(x)) / 2) for v in x]
    assert max(abs(a - b / sum(e)) for a, b in zip(got[1], e, strict=True)) < 1e-12
    assert got[2] is None and got[3] == []


def test_job_progress_is_kept_by_joins(spark):
    """Counts go on over deliveries, for rows without a job id too; a replayed epoch changes nothing (F2)."""
    rows = [(None if k % 4 == 0 else k % 4, "bad" if k < 4 else None, dt.datetime(2024, 1, 1 + k)) for k in range(24)]
    results = spark.createDataFrame(rows, "job_id long, error_message string, created_at timestamp")
    totals = spark.createDataFrame([(1, 4), (2, 100)], "job_id long, total_rows long")
    got = {r.job_id: tuple(r)[1:] for r in ST.stream_job_progress(spark, results, totals, deliveries=3).collect()}
    assert got == {None: (6, 1, None, "processing"), 1: (4, 1, 4, "completed"), 2: (6, 1, 100, "processing"), 3: (6, 1, None, "processing")}
    sink = ST.ProgressSink(spark, scratch_path(spark, "f2"), totals)
    for epoch in (0, 0, 1, 1):
        sink(results.where(F.dayofmonth("created_at") <= 12 if epoch == 0 else F.dayofmonth("created_at") > 12), epoch)
    assert {r.job_id: r.processed_rows for r in sink.read().collect()} == {None: 6, 1: 6, 2: 6, 3: 6}


def test_features_are_taken_in_parts(monkeypatch):
    """What a worker holds of a batch at once has a bound, and sums of parts are those of the whole (F5-F8, F12-F14)."""
    texts = ["", None, "ab", "abcabc", "é😀x\u0000y", "naïve 日本語 text"] + ["".join("abc dé日"[(k * j) % 7] for j in range(40)) for k in range(30)]
    of = np.arange(len(texts)) % 3
    want = Counter((t[j: j + 3], k % 3) for k, t in enumerate(texts) if t for j in range(len(t) - 2))
    known = sorted({g for g, _ in want})[::2]
    for windows, table in ((1 << 20, 1 << 22), (50, 1 << 22), (50, 10)):
        monkeypatch.setattr(G, "WINDOWS", windows)
        monkeypatch.setattr(G, "TABLE", table)
        got, found, index = Counter(), Counter(), G.GramIndex(G.packed(known))
        for keys, label, n in G.gram_counts(pa.array(texts), of, 3):
            got.update(dict(zip(zip(G.unpacked(keys), label.tolist()), n.tolist())))
        assert got == want
        for points, at, owner in G.windows(pa.array(texts)):
            assert len(at) <= windows
            found.update(known[k] for k in index.found(points, at).tolist() if k >= 0)
        assert found == Counter({g: sum(want[g, k] for k in range(3)) for g in known})
        lists = pa.array([t and t.split(" ") for t in texts], pa.list_(pa.string()))
        parts = [(w[k], r) for w, at, row in G.tokens(lists) for k, r in zip(at.tolist(), row.tolist())]
        assert parts == [(w, r) for r, x in enumerate(lists.to_pylist()) for w in x or []]


def test_patterns_behind_fixed_marks(spark):
    """A fixed string that a pattern needs is looked for first; what is replaced stays the same (F3, F7, F8, F10, F11)."""
    texts = ["", None, "a@b.co c", "x http://a.b y", "https:/no", "call 555-123-4567.", "5551234567", "1555-123-4567", "hi!! ok?? so.....", "!?!",
             "@me #tag a#b", "٥٥٥-١٢٣-٤٥٦٧", " ", " \t\x1c", "a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    plain = {T.strip_urls: [(T.URL, "")], T.strip_emails: [(T.EMAIL, "")], T.strip_phones: [(T.PHONE, "")],
             T.unwrap_mentions_hashtags: [(T.MENTION, "$1"), (T.HASHTAG, "$1")], T.drop_mentions_hashtags: [(T.MENTION, ""), (T.HASHTAG, "")],
             T.squeeze_punctuation: [(r"([!?])\1+", "$1"), (r"\.{4,}", "...")]}
    for f, steps in plain.items():
        c = F.col("t")
        for pattern, by in steps:
            c = F.regexp_replace(c, pattern, by)
        assert df.where(~f("t").eqNullSafe(c)).count() == 0, f
        assert "contains" in str(f("t")).lower() or f is T.strip_phones
    blank = {r.id for r in df.where(T.is_blank("t")).collect()}
    assert blank == {k for k, t in enumerate(texts) if not (t or "").strip()}


def test_range_partitions_follow_the_table(spark, tmp_path):
    """A table of many bytes is numbered in more partitions than the session shuffles to (F9)."""
    rows = spark.range(3000).select((F.col("id") % 7).alias("job"), F.col("id").alias("x"))
    rows.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert partitions(t) == 8 and 8 < partitions(t, 1000) < 100
    got = index_within(t, "job", ["x"]).collect()
    assert all(r.row_index == r.x // 7 for r in got) and len(got) == 3000


def test_projection_of_words_by_counts():
    """Sums of count x IDF x signs, for texts longer than a part too (F4)."""
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, TP.BUCKETS, n).tolist() for n in (0, 5, 40000, 1)] + [None] + [[7, 7, 9]] * 600
    idf = rng.random(TP.BUCKETS)
    got = TP.project(pa.array(lists, pa.list_(pa.int32())), idf)
    for k in (0, 1, 2, 3, 4, 5, 604):
        b = np.array(lists[k] or [], dtype=np.int64)
        want = (TP._signs(b) * idf[b][:, None]).sum(axis=0) if len(b) else np.zeros(TP.DIMS)
        size = np.sqrt((want * want).sum())
        assert np.allclose(got[k], want / size if size else want, atol=1e-12)

def test_suffixes_are_gone_before_texts_are_dealt(spark, monkeypatch):
    """op7: ranges known from whole runs are written, and the runs deleted, before the texts are shuffled."""
    import glob

    from verba.llm import suffix as S
    from verba.session import ensure_checkpoint_dir

    base, of, seen = ensure_checkpoint_dir(spark).removeprefix("file:"), S._contexts, []

    def contexts(*args):
        seen.append([len(glob.glob(f"{base}/verba-llm/**/{kind}/*.parquet", recursive=True)) for kind in ("spans", "blocks", "shared")])
        return of(*args)

    before = [len(glob.glob(f"{base}/verba-llm/**/{kind}/*.parquet", recursive=True)) for kind in ("spans", "blocks", "shared")]
    monkeypatch.setattr(S, "_contexts", contexts)
    body = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(900))
    texts = [body, body, "x" * 50 + body[100:500] + "y" * 90, "short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.n_removed for r in S.remove_repeats(df).select(F.col("_row.doc_id").alias("id"), "n_removed").collect()}
    assert seen and seen[0][0] > before[0] and seen[0][1:] == before[1:]
    assert (got[0], got[1], got[2], got[3] or 0, got[4] or 0) == (900, 900, 400, 0, 0)


def test_report_rows_are_dealt_before_they_are_formatted(spark, monkeypatch):
    """The pass that finds the bounds formats no line, and the header takes no pass of its own (F17)."""
    seen, path = [], scratch_path(spark, "f17")
    of = IO.csv_report
    monkeypatch.setattr(IO, "csv_report", lambda df, *more: seen.append(df) or of(df, *more))
    df = spark.range(50).select(F.when(F.col("id") > 4, F.col("id") % 3).alias("job_id"), F.col("id").alias("row_index"), F.lit('a "b"').alias("text"),
                                F.lit("spam").alias("prediction"), F.lit(0.5).alias("confidence"), F.lit("en").alias("language"),
                                F.lit(0.001).alias("processing_time"), F.lit(None).cast("string").alias("error_message"))
    IO.write_csv_report(df, path, ["job_id", "row_index"])
    assert all("RepartitionByExpression" in x._jdf.queryExecution().analyzed().toString() for x in seen)
    files = sorted((r.path, bytes(r.content).decode()) for r in spark.read.format("binaryFile").load(path).collect())
    lines = "".join(c for _, c in files).splitlines()
    order = [*range(5), *sorted(range(5, 50), key=lambda k: (k % 3, k))]
    assert lines == [",".join(IO.REPORT_HEADERS), *(f'{k},"a ""b""",spam,50.00%,en,1,' for k in order)]


def test_index_within_needs_no_join_by_key(spark):
    """Rows are numbered where they lie; a hot key goes on over partitions and batches, a null one is left out (F17)."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 > 0, F.concat(F.lit("k"), F.col("id") % 40))
    t = spark.range(900).select((-F.col("id")).alias("x"), key.alias("job"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = index_within(t, "job", ["x"])
        got = {(r.job, r.x): r.row_index for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = sorted((r.job, r.x) for r in t.collect() if r.job)
    count = Counter()
    want = {}
    for job, x in rows:
        want[job, x] = count[job]
        count[job] += 1
    assert got == want and df.columns == ["job", "x", "row_index"]
    assert df._jdf.queryExecution().analyzed().toString().count("Join ") == 1  # with a row for each partition


def test_range_partitions_of_a_join(spark):
    """The product of a join's sides says nothing of its size: what is read bounds it (F17)."""
    a = materialize(spark.range(20_000))
    assert partitions(a.join(a.withColumnRenamed("id", "j"), F.col("id") == F.col("j")), 1 << 20) == 8


def test_events_are_folded_where_they_lie(spark, monkeypatch):
    """Jobs that a range partition holds whole leave one row, whatever their events; a hot job, one without an id and
    parts that end within a batch of the task give what a plain fold gives (F15)."""
    rng, log = np.random.default_rng(15), []
    for job, n in [(None, 30), (7, 3000), *((k, int(k % 9)) for k in range(8, 400))]:
        kinds = rng.choice(["start", "ok", "failed_text", "complete", "fail", "odd"], n, p=[.1, .55, .25, .02, .02, .06])
        log += [(job, k // 2, k % 2, str(e), int(k) if e == "start" and k % 3 else None) for k, e in enumerate(kinds)]
    want = {}
    for job, _, _, e, total in log:
        x = want.setdefault(job, {"state": "new", "texts": 0, "last": 0, "total": None, "failed": 0, "rejected": 0})
        if (x["state"], e) not in J.MOVES:
            x["rejected"] += 1
            continue
        x["state"] = J.MOVES[x["state"], e]
        x["texts"] += e in ("ok", "failed_text")
        x["failed"] += e == "failed_text"
        x["last"] = x["texts"] if e == "ok" else x["last"]
        x["total"] = total if e == "start" else x["total"]
    frames = []
    monkeypatch.setattr(J, "materialize", lambda df: frames.append(materialize(df)) or frames[-1])
    rng.shuffle(log)
    df = spark.createDataFrame([tuple(r) for r in log], "job_id long, ts long, seq int, event string, total long")
    df = df.select(F.col("job_id").cast("long"), "ts", "seq", "event", "total")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.job_id: r for r in J.fold_job_events(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want)
    for job, x in want.items():
        done = x["state"] == "completed"
        processed = (x["texts"] if x["total"] is None else x["total"]) if done else x["last"]
        assert (got[job].state, got[job].processed, got[job].total, got[job].failed, got[job].rejected) == (
            x["state"], processed, x["total"], x["failed"], x["rejected"]), job
    assert frames[-1].count() <= len(want) + 8 * len(J.STATES) * 2
    assert frames[-1].where("job_id = 7").select("_p").distinct().count() > 1


def test_texts_are_dealt_once_for_common_grams(spark, monkeypatch):
    """op7: a gram with very many contexts costs no second shuffle of the texts, and the compare begins after the first is gone."""
    import glob
    import random

    from verba.llm import suffix as S
    from verba.session import ensure_checkpoint_dir

    monkeypatch.setattr(S, "GROUP", 2)
    base, dealt, left = ensure_checkpoint_dir(spark).removeprefix("file:"), [], []
    edges = lambda: len(glob.glob(f"{base}/verba-llm/**/edges/*.parquet", recursive=True))
    before, contexts, compare = edges(), S._contexts, S._compare
    monkeypatch.setattr(S, "_contexts", lambda *a: (dealt.append(edges()), contexts(*a))[1])
    monkeypatch.setattr(S, "_compare", lambda *a: (left.append(edges()), compare(*a))[1])
    body = "".join(random.Random(7).choices("abcdefghij", k=900))  # noqa: S311
    texts = [chr(65 + k) * 50 + body[100:500 + k] + chr(70 + k) * 90 for k in range(9)] + [body[90:300], "short", None]
    rows = list(enumerate(texts)) + [(20, body[:330]), (20, body[:330])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.id, r.n_removed or 0) for r in S.remove_repeats(df).select(F.col("_row.doc_id").alias("id"), "n_removed").collect())
    assert len(dealt) == 1 and dealt[0] > before and left == [before]
    # the last of the nine holds body[100:508], of which body[507] is in no string that starts elsewhere too
    assert got == [*((k, 400 + min(k, 7)) for k in range(9)), (9, 210), (10, 0), (11, 0), (20, 330), (20, 330)]
