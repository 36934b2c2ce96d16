"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits through anchor points."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import components, field, forest, row_key, unpacked, written

HALF = 32  # bits of a half; its code is the Hamming code on 31 bits, and one free bit
RADIUS = 1  # every half has an anchor within one bit
BLOCK = 1 << 20  # pairs compared at a time
ANCHOR_ROWS = 1 << 14  # fingerprints of a block; larger anchors are compared block by block


def fingerprints(shingle: int):
    """pandas UDF: text as binary -> fingerprint as a signed long. Null or wordless text: zero."""
    from pyspark.sql.functions import pandas_udf

    def one(text, n=shingle):
        import numpy as np
        from xxhash import xxh64_intdigest

        words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space only
        if not words:
            return 0
        joined = b" ".join(words)
        if len(words) <= n:
            h = np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
        else:
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            end = np.cumsum(size + 1) - 1
            first = (end - size)[: len(words) - n + 1].tolist()
            last = end[n - 1:].tolist()
            h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], dtype=np.uint64)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[at: at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")
        return int(bits.view(np.int64)[0])

    @pandas_udf("long")
    def udf(text):
        import pandas as pd

        return pd.Series([one(x) for x in text], dtype="int64")

    return udf.asNondeterministic()  # evaluate once: never copied into a filter or a second projection


def _syndrome(mask: int) -> int:
    out = 0
    for i in range(HALF - 1):
        if mask >> i & 1:
            out ^= i + 1
    return out


def anchor_masks(spark, reach: int) -> DataFrame:
    """Every flip of at most ``reach`` bits of a half, by the syndrome that it clears: applied to a half
    of that syndrome it gives an anchor. Its size depends on ``reach`` alone (529 rows for two bits)."""
    rows = []
    for k in range(reach + 1):
        for bits in combinations(range(HALF), k):
            m = sum(1 << b for b in bits)
            s = _syndrome(m)
            home = m == 0 or (k == 1 and bits[0] < HALF - 1)
            rows.append((s, m, home))
    return spark.createDataFrame(rows, "_s int, _mask long, home boolean")


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (anchor, home, fp) -> the same, where an anchor of more than ANCHOR_ROWS is cut into blocks of
    homes x blocks of rows, each pair a group with an anchor number of its own."""
    blocks = lambda c: F.ceil(c / F.lit(ANCHOR_ROWS)).cast("int")
    large = written(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.count_if("home").alias("_m")).where(
        (F.col("_n") > ANCHOR_ROWS) & (F.col("_m") > 0)).select("anchor", blocks(F.col("_m")).alias("_hs"), blocks(F.col("_n")).alias("_rs")), "large")
    rows = rows.join(large, "anchor", "left")
    place = lambda i, j, home: F.struct(i.cast("int").alias("_i"), j.cast("int").alias("_j"), home.alias("home"))
    one = F.array(place(F.lit(0), F.lit(0), F.col("home")))
    own = lambda c: F.pmod(F.xxhash64("fp"), F.col(c))
    as_row = F.transform(F.sequence(F.lit(0), F.col("_hs") - 1), lambda i: place(i, own("_rs"), F.lit(False)))
    as_home = F.transform(F.sequence(F.lit(0), F.col("_rs") - 1), lambda j: place(own("_hs"), j, F.lit(True)))
    many = F.when(F.col("home"), F.concat(as_home, as_row)).otherwise(as_row)
    return rows.select("anchor", "fp", F.explode(F.when(F.col("_hs").isNull(), one).otherwise(many)).alias("_p")) \
        .select(F.when((F.col("_p._i") == 0) & (F.col("_p._j") == 0), F.col("anchor")).otherwise(
            F.xxhash64("anchor", "_p._i", "_p._j")).alias("anchor"), F.col("_p.home").alias("home"), "fp")


def near_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Distinct fingerprints ``fps(fp long)`` -> edges (u, v) that connect, directly or through others,
    exactly those pairs that differ in at most ``max_bits`` bits.

    Anchor points: two fingerprints within ``max_bits`` agree in one 32-bit half up to
    ``max_bits // 2`` bits. The anchors of a half are a covering code of radius 1 (the perfect Hamming
    code on 31 bits, times the free bit). A fingerprint has one home, its nearest anchor, and is copied
    to each anchor within radius plus threshold: so the home of either of a pair holds both. At an
    anchor only home fingerprints are compared with the rest, by the whole 64 bits; a task hands on a
    spanning forest of the links it found, not all pairs. An anchor of more than ANCHOR_ROWS fingerprints is
    cut in blocks by hash, so that no group holds more than a block of homes and one of rows. Groups whose
    keys collide are compared together, which only adds comparisons."""
    spark = fps.sparkSession
    masks = anchor_masks(spark, RADIUS + max_bits // 2)
    full = (1 << HALF) - 1
    half = F.when(F.col("_b") == 0, F.col("fp")).otherwise(
        F.shiftrightunsigned("fp", HALF))
    rows = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("_b")).withColumn("_h", half.bitwiseAND(F.lit(full)))
    s = F.lit(0)
    for k in range(5):
        parity = sum(1 << i for i in range(HALF - 1) if (i + 1) >> k & 1)
        s = s + (F.bit_count(F.col("_h").bitwiseAND(F.lit(parity))) % 2) * (1 << k)
    rows = rows.withColumn("_s", s.cast("int")).join(F.broadcast(masks), "_s").select(
        (F.col("_h").bitwiseXOR(F.col("_mask")) + F.col("_b").cast("long") * (full + 1)).alias("anchor"), "home", "fp")
    rows = in_blocks(rows)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "anchor").sortWithinPartitions("anchor", F.desc("home"))

    def compare(batches, max_bits=max_bits, block=BLOCK):
        import numpy as np
        import pandas as pd

        def groups(a, home, fp):
            """Links of whole anchors; rows are sorted by anchor, home rows first."""
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            size = np.diff(np.r_[first, len(a)])
            homes = np.add.reduceat(home.astype(np.int64), first)
            us, vs = [], []
            use = np.flatnonzero((size > 1) & (homes > 0))
            small = use[(homes[use] * size[use]) <= 4096]
            for lo in range(0, len(small), 256):
                g = small[lo: lo + 256]
                pairs = homes[g] * size[g]
                at = np.repeat(np.arange(len(g)), pairs)
                k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                x = fp[first[g][at] + k // size[g][at]]
                y = fp[first[g][at] + k % size[g][at]]
                ok = (x != y) & (np.bitwise_count(x ^ y) <= max_bits)
                us.append(x[ok])
                vs.append(y[ok])
            for g in use[(homes[use] * size[use]) > 4096]:
                every = fp[first[g]: first[g] + size[g]]
                step = max(1, block // len(every))
                for lo in range(0, homes[g], step):
                    x = every[lo: min(lo + step, homes[g])]
                    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ every[None, :]) <= max_bits)
                    ok = x[i] != every[j]
                    if ok.any():
                        node, root = forest(x[i[ok]].view(np.int64), every[j[ok]].view(np.int64))
                        us.append(node.view(np.uint64))
                        vs.append(root.view(np.uint64))
            if not us:
                return None
            u, v = np.concatenate(us), np.concatenate(vs)
            if not len(u):
                return None
            node, root = forest(u.view(np.int64), v.view(np.int64))
            return pd.DataFrame({"u": node, "v": root})

        held, rows_held = [], 0
        for part in batches:
            part = (part["anchor"].to_numpy(), part["home"].to_numpy(dtype=bool), part["fp"].to_numpy().view(np.uint64))
            held.append(part)
            rows_held += len(part[0])
            if rows_held < 200_000 or held[0][0][0] == part[0][-1]:
                continue
            a, home, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            out = groups(a[:cut], home[:cut], fp[:cut])
            if out is not None:
                yield out
            held, rows_held = [(a[cut:], home[cut:], fp[cut:])], len(a) - cut
        if held:
            out = groups(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if out is not None:
                yield out

    return rows.mapInPandas(compare, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 3) -> DataFrame:
    """One row per input row: _k1, _k2 (its row key), the id, fingerprint (16 hex digits), component_id
    (smallest id reachable by links) and kept (true for the row that stands for its component).

    Null and wordless texts have fingerprint zero and link like any other. A null id counts as larger
    than any other; a component of null ids only has a null component_id. Repeated rows share their key
    and are all in the component; ``keep_one`` leaves one of them. Empty table: no rows. Other columns
    are only read for the row key, so their names cannot clash."""
    keyed = row_key(docs, id_col)
    table = written(keyed.select("_k1", "_k2", field(id_col).cast("long").alias("_id"),
                                 fingerprints(shingle)(field(text_col).cast("binary")).alias("fp")), "fingerprints")
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_k2").alias("k"))
    fps = written(table.groupBy("fp").agg(F.min(rank).alias("low")), "distinct")
    links = components(near_links(fps.select("fp"), max_bits))
    member = fps.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = member.groupBy("root").agg(F.min("low").alias("rep"))
    label = member.select("fp", "root").join(lows, "root").select("fp", "rep")
    return table.join(label, "fp").select(
        "_k1", "_k2", F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("rep.i").alias("component_id"),
        ((F.col("rep.i").eqNullSafe(F.col("_id"))) & (F.col("rep.k") == F.col("_k2"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, with its columns, one for each component: the one with the smallest id
    (nulls last; of rows with that id the one with the smallest row key; of equal rows one)."""
    stay = simhash_components(docs, id_col, text_col, shingle, max_bits).where("kept").select("_k1", "_k2").distinct()
    rows = row_key(docs, id_col).join(stay, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return unpacked(rows, docs.columns)
