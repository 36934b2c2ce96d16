"""Exact removal of long repeated byte strings with a logarithmic family of sampled suffix arrays."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.llm.common import discard, field, row_key, scratch, shared_path, written

GRAM = 32  # bytes at the head of a suffix by which the arrays are ordered
PIECE = 1 << 18  # bytes hashed at a time in a task
HOT_RUN, HOT_RUNS = 1_000, 100_000  # a run is common above so many suffixes, or above the total over HOT_RUNS
GROUP = 20_000  # distinct contexts of one gram that a task compares; beyond it windows are counted by a shuffle
ENTRY = "anchor long, block long, d int, n int, l int, _k1 long, _k2 long"
SPANS = "_k1 long, _k2 long, s int, e int"


def _hashes():
    """numpy helpers: hashes of fixed-length substrings at every position, built by doubling."""
    import numpy as np

    k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    seeds = np.arange(1, 257, dtype=np.uint64) * k1
    seeds = (seeds ^ (seeds >> np.uint64(29))) * k2
    seeds ^= seeds >> np.uint64(32)

    def comb(a, b):
        x = a * k1
        x += b * k2
        x ^= x >> np.uint64(31)
        return x

    def ladder(data, top):
        """{1, 2, 4, ... top: hash of that many bytes from each position}."""
        out, size = {1: seeds[data]}, 1
        while size < top:
            h = out[size]
            out[2 * size] = comb(h[: len(h) - size], h[size:]) if len(h) > size else h[:0]
            size *= 2
        return out

    def window(steps, at, length):
        """Hash of ``length`` bytes from each position of ``at``; steps: a ladder up to GRAM."""
        h, done = None, 0
        size = max(steps)
        while done < length:
            while size > length - done:
                size //= 2
            x = steps[size][at + done]
            h = x if h is None else comb(h, x)
            done += size
        return h

    return comb, ladder, window


def _entries(texts, min_len: int):
    """Of a list of byte strings: the sampled suffixes as arrays (which text, anchor, block, d, n, l).

    Each window of ``min_len`` bytes has as its anchor the gram of least hash in it, the first of
    equals, which depends on the window's bytes alone. Neighbouring windows with one anchor make a
    run: window starts l..l+n, anchor at l+d; block is a hash of all bytes that the run covers."""
    import numpy as np

    comb, ladder, window = _hashes()
    span = min_len - GRAM + 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    base = np.cumsum(sizes) - sizes
    found = []
    for lo in range(0, max(0, len(data) - min_len + 1), PIECE):
        part = data[lo: lo + PIECE + min_len - 1]
        count = len(part) - min_len + 1
        if count <= 0:
            break
        steps = ladder(part, GRAM)
        gram = steps[GRAM]
        low = (gram >> np.uint64(20) << np.uint64(20)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[:count], low[span - width: span - width + count])
        at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        edge = np.zeros(count + 1, dtype=np.int8)  # +1 where a text's windows begin, -1 after its last
        first = np.clip(base - lo, 0, count)
        last = np.clip(base + sizes - min_len + 1 - lo, 0, count)
        ok = sizes >= min_len
        np.add.at(edge, first[ok], 1)
        np.add.at(edge, last[ok], -1)
        valid = np.cumsum(edge[:count]) > 0
        change = np.ones(count, dtype=bool)
        change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        begin = np.flatnonzero(change)
        end = np.r_[begin[1:], count] - 1
        use = valid[begin]
        begin, end = begin[use], end[use]
        if not len(begin):
            continue
        a = at[begin]
        d, n = a - begin, end - begin
        block = comb(window(steps, begin, min_len), window(steps, end, min_len))
        doc = np.searchsorted(base, begin + lo, side="right") - 1
        # empty texts share their base with the next one: the last of equals is the one with bytes
        found.append((doc, gram[a].view(np.int64), block.view(np.int64), d, n, begin + lo - base[doc]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def suffix_entries(rows: DataFrame, min_len: int) -> DataFrame:
    """rows (_k1, _k2, _t binary) -> sampled suffixes, ENTRY. No text is shuffled."""

    def make(batches, min_len=min_len):
        import pandas as pd

        for part in batches:
            texts, k1, k2 = part["_t"].tolist(), part["_k1"].to_numpy(), part["_k2"].to_numpy()
            lo = 0
            while lo < len(texts):
                hi, total = lo, 0
                while hi < len(texts) and (hi == lo or total + len(texts[hi] or b"") <= 8 * PIECE):
                    total += len(texts[hi] or b"")
                    hi += 1
                got = _entries([t or b"" for t in texts[lo:hi]], min_len)
                if got is not None:
                    doc, anchor, block, d, n, at = got
                    yield pd.DataFrame({"anchor": anchor, "block": block, "d": d.astype("int32"), "n": n.astype("int32"),
                                        "l": at.astype("int32"), "_k1": k1[lo:hi][doc], "_k2": k2[lo:hi][doc]})
                lo = hi

    return rows.mapInPandas(make, ENTRY)


class SuffixIndex:
    """A logarithmic family of suffix arrays in the shared folder.

    A batch's array is a set of sorted runs: the suffixes that a task read, ordered by the hash of a suffix's
    first GRAM bytes (any order that brings equal heads together serves matches of a fixed least length).
    Beside it lies its head table, the distinct heads with their counts: a bucketed table, each bucket sorted
    by head. insert() merge-scans the new batch's heads against those of all levels, bucket by bucket: a
    sort-merge join of tables that are bucketed alike, which shuffles neither. A head is one row of a
    level however many texts have it, so a common one is no larger than any other. Then equal-sized levels
    merge, their head tables by the same kind of join and their arrays by reference, so that n batches leave
    log2(n) + 1 levels at most and a head is rewritten log2(n) times at most. Heads that recur are where
    long matches can be; their suffixes alone are compared afterwards.

    With ``path`` the family is kept there, for batches that come later and from other sessions: add() takes
    one more batch of documents and ends with a commit, a manifest that names all files of the family. A
    failure before it leaves the family at ``path`` as it was, to be opened anew; files that a commit made
    needless go after it. One writer at a time. The length of matches and the number of buckets are those
    it was made with. add() shuffles the batch; of the levels it reads head tables and arrays once."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_len: int = 200):
        self.spark, self.path, self.min_len = spark, path and path.rstrip("/"), min_len
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # (batches in it, its head table's name and path, its arrays and their paths); largest first
        self.levels: list[tuple[int, str, str, list[tuple[DataFrame, str]]]] = []
        self.texts: list[str] = []  # of batches given to add(), the rows (_k1, _k2, _t)
        self.found: list[str] = []  # of each of them, the ranges that it showed to be repeated
        self.version, self.needless = 0, []
        if self.path:
            self._open()

    def _open(self) -> None:
        spark = self.spark
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName()) for s in files.listStatus(folder)] if files.exists(folder) else []
        done = [v for v in done if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{v}/_SUCCESS"))]
        if not done:
            return
        self.version = max(done)
        kept = json.loads(spark.read.text(f"{self.path}/manifests/{self.version}").first()["value"])
        self.min_len, self.buckets, self.texts, self.found = kept["min_len"], kept["buckets"], kept["texts"], kept["found"]
        for batches, name, path, arrays in kept["levels"]:
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} (anchor BIGINT, n BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) "
                          f"INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.levels.append((batches, name, path, [(spark.read.schema(ENTRY).parquet(a), a) for a in arrays]))

    def _commit(self) -> None:
        levels = [(n, name, path, [a for _, a in arrays]) for n, name, path, arrays in self.levels]
        kept = {"min_len": self.min_len, "buckets": self.buckets, "texts": self.texts, "found": self.found, "levels": levels}
        manifest = f"{self.path}/manifests/{self.version + 1}"
        self.spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
        if self.version:
            self.needless.append(f"{self.path}/manifests/{self.version}")
        self.version += 1
        discard(self.spark, *self.needless)
        self.needless = []

    def _new(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}" if self.path else shared_path(self.spark, kind)

    def _heads(self, df: DataFrame) -> tuple[str, str]:
        """Write (anchor, n) as a bucketed, sorted table -> (name, path)."""
        path, name = self._new("heads"), f"heads_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", path).saveAsTable(name)
        return name, path

    def _forget(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        if self.path:
            self.needless.append(path)  # the last manifest still names it
        else:
            discard(self.spark, path)

    def insert(self, array: DataFrame, path: str, hits: str) -> DataFrame:
        """array, which lies at ``path`` -> (anchor), written to ``hits``: heads of it that occur twice in
        it, or in it and a level. Its own heads are counted per task before they are shuffled."""
        own = self._heads(array.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")))
        table = self.spark.table(own[0])
        found = table.where("n > 1").select("anchor")
        for _, name, _, _ in self.levels:
            found = found.unionByName(table.select("anchor").join(self.spark.table(name).select("anchor"), "anchor"))
        found = written(found, "hits", hits)
        self.levels.append((1, *own, [(array, path)]))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (m, x, old, xs), (n, y, older, ys) = self.levels.pop(), self.levels.pop()
            both = merged_heads(self.spark.table(y), self.spark.table(x))
            self.levels.append((m + n, *self._heads(both), ys + xs))
            self._forget(x, old)
            self._forget(y, older)
        return found

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """One more batch of documents for a family that is kept: its suffix array is merge-scanned against
        all levels, the suffixes whose heads recur are compared, and the ranges that are now known to be
        repeated, in this batch or an earlier one, are kept with it. Texts of earlier batches are read
        where a head of theirs recurs. Rows as in remove_repeats(); a batch without rows is one too."""
        spark, texts, spans = self.spark, self._new("texts"), self._new("spans")
        rows = written(row_key(docs, id_col).select("_k1", "_k2", _bytes(text_col).alias("_t")), "texts", texts)
        path = self._new("arrays")
        array = written(suffix_entries(rows, self.min_len).sortWithinPartitions("anchor"), "arrays", path)
        with scratch(spark):
            hits = self.insert(array, path, shared_path(spark, "hits")).distinct()
            self.texts.append(texts)
            again = written(self.suffixes().join(hits, "anchor", "left_semi"), "again")
            spans_of(spark.read.schema(rows.schema).parquet(*self.texts), again, self.min_len, spans)
        self.found.append(spans)
        self._commit()

    def spans(self) -> DataFrame:
        """(_k1, _k2, s, e): all ranges that the batches given to add() have shown to be repeated."""
        return self.spark.read.schema(SPANS).parquet(*self.found) if self.found else self.spark.createDataFrame([], SPANS)

    def remove_repeats(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", valid_text: bool = False) -> DataFrame:
        """remove_repeats() of documents that were given to add(), in whichever batches: judged by all
        batches so far. Documents that were never added stay whole."""
        return cut_rows(row_key(docs, id_col), self.spans(), text_col, valid_text)

    def suffixes(self) -> DataFrame:
        arrays = [df for level in self.levels for df, _ in level[3]]
        out = arrays[0]
        for df in arrays[1:]:
            out = out.unionByName(df)
        return out

    def drop(self) -> None:
        for _, name, path, arrays in self.levels:
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, path, *[p for _, p in arrays])
        if self.path:
            discard(self.spark, self.path)
        self.levels, self.texts, self.found, self.version, self.needless = [], [], [], 0, []


def merged_heads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two head tables as one: a merge of sorted buckets."""
    b = b.select("anchor", F.col("n").alias("m"))
    return a.join(b, "anchor", "full_outer").select("anchor", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def new_arrays(rows: DataFrame, min_len: int, batches: int) -> list[tuple[DataFrame, str]]:
    """The suffix arrays of ``batches`` batches and their paths, made in one pass over the texts."""
    spark = rows.sparkSession
    e = suffix_entries(rows, min_len).withColumn("batch", F.pmod(F.xxhash64("_k2"), F.lit(batches)).cast("int"))
    path = shared_path(spark, "arrays")
    e.sortWithinPartitions("batch", "anchor").write.partitionBy("batch").parquet(path)
    arrays = spark.read.schema(f"{ENTRY}, batch int").parquet(path)
    return [(arrays.where(F.col("batch") == b).drop("batch"), f"{path}/batch={b}") for b in range(batches)]


def _grams_again(rows: DataFrame, min_len: int, batches: int) -> DataFrame:
    """Written: the suffixes of all texts whose gram occurs more than once."""
    spark = rows.sparkSession
    index, found, hits = SuffixIndex(spark, min_len=min_len), None, shared_path(spark, "hits")
    for k, (array, path) in enumerate(new_arrays(rows, min_len, batches)):
        new = index.insert(array, path, f"{hits}/{k}")
        found = new if found is None else found.unionByName(new)
    # both sides are plain shuffles, so adaptive execution splits a common gram's suffixes
    twice = shared_path(spark, "twice")
    again = written(index.suffixes().join(written(found.distinct(), "twice", twice), "anchor", "left_semi"), "again")
    index.drop()
    discard(spark, hits, twice)
    return again


def _contexts(joined: DataFrame, min_len: int) -> DataFrame:
    """joined (_k1, _k2, _t, x array of runs) -> a row for each run with the bytes it covers."""

    def cut(batches, min_len=min_len):
        import pandas as pd

        names = ["anchor", "_k1", "_k2", "l", "d", "n", "edge", "hot", "ctx"]
        for part in batches:
            out = []
            for k1, k2, text, runs in zip(part["_k1"], part["_k2"], part["_t"], part["x"], strict=True):
                out.extend((r["anchor"], k1, k2, r["l"], r["d"], r["n"], r["edge"], r["hot"], text[r["l"]: r["l"] + r["n"] + min_len]) for r in runs)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return joined.mapInPandas(cut, "anchor long, _k1 long, _k2 long, l int, d int, n int, edge boolean, hot boolean, ctx binary")


def _windows(contexts: DataFrame, min_len: int) -> DataFrame:
    """A row for each window of the contexts: h is a hash of its gram, the gram's place in it and its bytes."""

    def cut(batches, min_len=min_len):
        import numpy as np
        import pandas as pd

        comb, ladder, window = _hashes()
        for part in batches:
            for lo in range(0, len(part), 2000):
                f = part.iloc[lo: lo + 2000]
                n, size = f["n"].to_numpy().astype(np.int64) + 1, f["ctx"].str.len().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h = window(ladder(np.frombuffer(b"".join(f["ctx"]), dtype=np.uint8), GRAM), (np.cumsum(size) - size)[row] + j, min_len)
                d = f["d"].to_numpy().astype(np.int64)[row] - j
                h = comb(comb(h, f["anchor"].to_numpy().view(np.uint64)[row]), d.view(np.uint64))
                yield pd.DataFrame({"h": h.view(np.int64), "_k1": f["_k1"].to_numpy()[row], "_k2": f["_k2"].to_numpy()[row],
                                    "l": (f["l"].to_numpy()[row] + j).astype("int32"), "edge": f["edge"].to_numpy()[row]})

    return contexts.mapInPandas(cut, "h long, _k1 long, _k2 long, l int, edge boolean")


def _compare(contexts: DataFrame, min_len: int) -> DataFrame:
    """Contexts of one gram against each other: (_k1, _k2, s, e) where windows of an edge run occur twice."""
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = contexts.repartition(n, "anchor").sortWithinPartitions("anchor", "_k1", "_k2", "l")

    def scan(batches, min_len=min_len):
        import numpy as np
        import pandas as pd

        comb, ladder, window = _hashes()

        def spans(f):
            """f: whole grams."""
            f = f[~f.duplicated(["anchor", "_k1", "_k2", "l"])]
            ctx, n = f["ctx"].tolist(), f["n"].to_numpy().astype(np.int64) + 1
            size = np.array([len(c) for c in ctx], dtype=np.int64)
            at0 = np.cumsum(size) - size
            steps = ladder(np.frombuffer(b"".join(ctx), dtype=np.uint8), GRAM)
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = window(steps, at0[row] + j, min_len)
            d = f["d"].to_numpy().astype(np.int64)[row] - j
            h = comb(comb(h, f["anchor"].to_numpy().view(np.uint64)[row]), d.view(np.uint64))
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            again = (times[back] > 1) & f["edge"].to_numpy(dtype=bool)[row]
            start = again.copy()
            start[1:] &= ~(again[:-1] & (row[1:] == row[:-1]))
            stop = again.copy()
            stop[:-1] &= ~(again[1:] & (row[1:] == row[:-1]))
            s, e = np.flatnonzero(start), np.flatnonzero(stop)
            if not len(s):
                return None
            l0 = f["l"].to_numpy().astype(np.int64)
            r = row[s]
            return pd.DataFrame({"_k1": f["_k1"].to_numpy()[r], "_k2": f["_k2"].to_numpy()[r],
                                 "s": (l0[r] + j[s]).astype("int32"), "e": (l0[r] + j[e] + min_len).astype("int32")})

        held, rows_held = [], 0
        for part in batches:
            held.append(part)
            rows_held += len(part)
            if rows_held < 4000 or held[0]["anchor"].iloc[0] == part["anchor"].iloc[-1]:
                continue
            f = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(f["anchor"].to_numpy(), f["anchor"].iloc[-1]))
            lo, a = 0, f["anchor"].to_numpy()
            while lo < cut:  # whole grams, some thousand rows at a time
                hi = min(cut, int(np.searchsorted(a, a[min(cut, lo + 4000) - 1], side="right")))
                if (out := spans(f.iloc[lo:hi])) is not None:
                    yield out
                lo = hi
            held, rows_held = [f.iloc[cut:]], len(f) - cut
        if held and (out := spans(pd.concat(held, ignore_index=True))) is not None:
            yield out

    return rows.mapInPandas(scan, SPANS)


def repeated_spans(rows: DataFrame, min_len: int = 200, batches: int = 3) -> DataFrame:
    """rows (_k1, _k2, _t binary) -> (_k1, _k2, s, e): byte ranges that are covered by strings of
    ``min_len`` bytes which start at least twice in all texts. Ranges of a text may overlap."""
    path = shared_path(rows.sparkSession, "spans")
    with scratch(rows.sparkSession):
        return spans_of(rows, _grams_again(rows, min_len, batches), min_len, path)


def spans_of(rows: DataFrame, again: DataFrame, min_len: int, path: str) -> DataFrame:
    """Compare the suffixes ``again`` of the texts in rows (_k1, _k2, _t), all those of their heads -> the
    repeated ranges SPANS, written to ``path``."""
    run, spark = ["anchor", "block", "d", "n"], rows.sparkSession
    own, edges = [shared_path(spark, "blocks"), shared_path(spark, "shared")], shared_path(spark, "edges")
    blocks = written(again.groupBy(*run).agg(F.count(F.lit(1)).alias("times"), F.min("_k1").alias("_k1"),
                                             F.min_by(F.struct("_k2", "l"), F.struct("_k1", "_k2", "l")).alias("rep")), "blocks", own[0])
    # a run whose bytes occur whole elsewhere: all its windows are repeated. Runs of a share of all suffixes are
    # few whatever the input, and are known by a broadcast list: their suffixes are dealt nowhere by run
    common = max(HOT_RUN, again.count() // HOT_RUNS)
    hot = F.broadcast(blocks.where(F.col("times") > common).select(*run, F.lit(True).alias("hot")))  # HOT_RUNS rows at most
    marked = again.join(hot, run, "left")
    some = marked.where("hot IS NULL").join(blocks.where((F.col("times") > 1) & (F.col("times") <= common)).select(*run), run)
    whole = marked.where("hot").select(*again.columns).unionByName(some.select(*again.columns)).select(
        "_k1", "_k2", F.col("l").alias("s"), (F.col("l") + F.col("n") + F.lit(min_len)).cast("int").alias("e"))
    # written before the texts are dealt, so that the shuffles of all suffixes are gone by then
    written(whole, "spans", path)
    del marked, some, hot, whole
    # the others that share their gram match in part: at the edges of a repeated string
    # written, so that both sides of the join are plain shuffles and adaptive execution splits a gram with many runs
    shared = written(blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("times").alias("low")).where("m > 1 AND low = 1"), "shared", own[1])
    part = written(blocks.join(shared, "anchor").select(
        "_k1", F.col("rep._k2").alias("_k2"), "anchor", F.col("rep.l").alias("l"), "d", "n",
        (F.col("times") == 1).alias("edge"), (F.col("m") > GROUP).alias("hot")), "edges", edges)
    del blocks, shared
    discard(spark, *own)  # the runs left to compare name all that is needed of them

    # the texts are dealt once, for the grams with many contexts too, and their shuffle is gone before the compare
    runs = part.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("anchor", "l", "d", "n", "edge", "hot")).alias("x"))
    contexts = written(_contexts(rows.join(runs.hint("shuffle_merge"), ["_k1", "_k2"]), min_len), "contexts")
    del part, runs
    discard(spark, edges)
    out = _compare(contexts.where("NOT hot"), min_len)
    if not contexts.where("hot").isEmpty():
        # an edge run's text occurs once, so its windows do too; rows that are equal in all count as often as they
        # occur, and are no edge. The counts are written, so that adaptive execution splits a common window's rows
        w = written(_windows(contexts.where("hot"), min_len), "windows")
        twice = written(w.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "twice")
        out = out.unionByName(w.where("edge").join(twice, "h").select(
            "_k1", "_k2", F.col("l").alias("s"), (F.col("l") + F.lit(min_len)).cast("int").alias("e")))
    out.write.mode("append").parquet(path)
    return spark.read.schema(SPANS).parquet(path)


def _cut_udf(valid_text: bool):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("kept binary, n_removed long, n_spans long")
    def cut(text, spans):
        import pandas as pd

        out = []
        for t, ss in zip(text, spans, strict=True):
            if t is None or ss is None:
                out.append((None, 0, 0))
                continue
            keep, at, removed, n = [], 0, 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in ss):
                if s > at or not n:
                    n += 1
                    keep.append(t[at:s])
                    at = s
                if e > at:
                    removed += e - at
                    at = e
            keep.append(t[at:])
            kept = b"".join(keep)
            out.append((kept.decode("utf-8", "ignore").encode() if valid_text else kept, removed, n))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    return cut.asNondeterministic()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, batches: int = 3,
                   valid_text: bool = False) -> DataFrame:
    """One row per input row: _row (the row), kept (binary: the bytes that stay), n_bytes, n_removed and
    n_spans (maximal removed runs). A byte goes if a string of ``min_len`` bytes that covers it starts
    anywhere else too, in this text or another; all are judged on the input. Repeated rows are other
    places. Null text is empty; a text shorter than ``min_len`` bytes stays whole. Ids may be null or
    repeat. With ``valid_text`` the bytes of a character cut in two go as well. Empty table: no rows."""
    keyed = row_key(docs, id_col)
    return cut_rows(keyed, repeated_spans(keyed.select("_k1", "_k2", _bytes(text_col).alias("_t")), min_len, batches), text_col, valid_text)


def _bytes(text_col: str):
    return F.coalesce(field(text_col).cast("binary"), F.lit(b""))


def cut_rows(keyed: DataFrame, spans: DataFrame, text_col: str, valid_text: bool) -> DataFrame:
    """row_key() rows without the ranges of their text."""
    # collect_set: a text has no more ranges than bytes, and equal rows bring equal ranges
    by_text = spans.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    cut = _cut_udf(valid_text)(F.when(F.col("spans").isNotNull(), F.col("_t")), F.col("spans"))
    # the row alone is shuffled, with its text in it once
    return keyed.join(by_text.hint("shuffle_merge"), ["_k1", "_k2"], "left").withColumn("_t", _bytes(text_col)).withColumn("_c", cut).select(
        "_row", F.coalesce("_c.kept", "_t").alias("kept"), F.octet_length("_t").cast("long").alias("n_bytes"),
        F.col("_c.n_removed").alias("n_removed"), F.col("_c.n_spans").alias("n_spans"))


def texts_without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
                          min_len: int = 200) -> DataFrame:
    """``docs`` with its columns; the text, where something was removed, is what stays of it, and
    ``chars_col`` its length. All rows stay."""
    cut = remove_repeats(docs, id_col, text_col, min_len, valid_text=True)
    changed, text = F.col("n_removed") > 0, F.col("kept").cast("string")
    values = {c: field(c) for c in docs.columns}
    values[text_col] = F.when(changed, text).otherwise(field(text_col))
    if chars_col in values:
        kind = docs.schema[chars_col].dataType
        values[chars_col] = F.when(changed, F.char_length(text).cast(kind)).otherwise(field(chars_col))
    return cut.select(*[v.alias(c) for c, v in values.items()])
