"""Embedding near-duplicates: sign hashing on random hyperplanes in several tables, exact cosine, components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import components, forest, written
from verba.session import bounded_broadcast

PER_BUCKET = 128  # vectors that a bucket should hold on average
BLOCK = 256  # vectors of a block; larger buckets are compared block by block
MISS = 1e-4  # chance that a pair right at the threshold shares no bucket


def table_plan(n: int, cosine: float, per_bucket: int = PER_BUCKET, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits so that n vectors fill buckets of ``per_bucket``, tables so that a pair at
    the threshold meets in one with probability 1 - miss. One formula for every size."""
    bits = max(4, math.ceil(math.log2(max(1, n) / per_bucket)) if n > per_bucket else 4)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def _unit(raw):
    """Rows as doubles of length one."""
    import numpy as np

    x = np.asarray(raw, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(rows: DataFrame, seed: int) -> DataFrame:
    """(_id, _raw) -> with _ok (a usable vector) and node and _h, two hashes of its direction."""
    def run(batches, seed=seed):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column("_raw")
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            flat = lists.flatten()
            flat = np.where(np.asarray(pc.is_null(flat)), np.nan, np.asarray(pc.fill_null(flat, 0.0), dtype=np.float64))
            first, ok, h = np.cumsum(size) - size, np.zeros(len(size), bool), np.zeros((2, len(size)), np.uint64)
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                x = flat[first[at][:, None] + np.arange(d)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, bits = at[good], (_unit(x[good]) + 0.0).view(np.uint64)
                odd = np.random.default_rng([seed, d]).integers(0, 1 << 63, (2, d), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                for k in (0, 1):
                    y = bits * odd[k]
                    y = (y ^ y >> np.uint64(31)) * odd[1 - k][::-1]
                    y = (y ^ y >> np.uint64(29)).sum(axis=1, dtype=np.uint64) * odd[k, 0]
                    h[k, at] = y ^ y >> np.uint64(32)
                ok[at] = True
            node, other = (pa.array(x.view(np.int64), mask=~ok) for x in h)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lists, pa.array(ok), node, other], names=["_id", "_raw", "_ok", "node", "_h"])

    return rows.mapInArrow(run, f"_id long, _raw {rows.schema['_raw'].dataType.simpleString()}, _ok boolean, node long, _h long")


def _signatures(bits: int, tables: int, seed: int):
    """pandas UDF: vector -> a bucket number for each table, all the signs as bits, and the vector as the bytes
    of its numbers."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("code array<long>, sig binary, vec binary")
    def sign(vectors):
        import numpy as np
        import pandas as pd

        out = [None] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):  # one matrix product for all vectors of a length
            at = np.flatnonzero(sizes == size)
            planes = np.random.default_rng([seed, int(size)]).standard_normal((int(size), bits * tables))
            raw = np.stack([vectors.iloc[i] for i in at])
            side = _unit(raw) @ planes > 0
            code = side.reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            packed = np.packbits(side, axis=1)
            for k, i in enumerate(at):
                out[i] = code[k], packed[k].tobytes(), raw[k].tobytes()
        return pd.DataFrame(out, columns=["code", "sig", "vec"])

    return sign


def _compare(pairs: DataFrame, cosine: float, bits: int, kind: str) -> DataFrame:
    """Rows of one (length, table, bucket, block pair) against each other: (node, other, links). With other null:
    ``links`` vectors were found for node; else an edge of a spanning forest. A pair counts in the first
    table that it shares, which the signatures tell, so nothing has to be de-duplicated. Vectors come as the
    bytes of the input's numbers, of ``kind``, and are compared as doubles."""

    def scan(batches, cosine=cosine, bits=bits, kind=kind):
        import numpy as np
        import pandas as pd

        key = ["_d", "_t", "_b", "_i", "_j"]

        def group(f):
            t, i, j = int(f["_t"].iloc[0]), int(f["_i"].iloc[0]), int(f["_j"].iloc[0])
            vec = _unit(np.frombuffer(b"".join(f["vec"]), dtype=kind).reshape(len(f), -1))
            sig = np.unpackbits(np.frombuffer(b"".join(f["sig"]), dtype=np.uint8).reshape(len(f), -1), axis=1)[:, : bits * t]
            sig = sig.reshape(len(f), t, bits) @ (1 << np.arange(bits, dtype=np.int64))
            node, many, part = f["node"].to_numpy(), f["many"].to_numpy(), f["_own"].to_numpy()
            a = np.flatnonzero(part == i)
            b = a if i == j else np.flatnonzero(part == j)
            if not len(a) or not len(b):
                return None
            links, us, vs = np.zeros(len(f), dtype=np.int64), [], []
            for lo in range(0, len(a), 1024):
                x = a[lo: lo + 1024]
                for lo2 in range(0, len(b), 1024):
                    y = b[lo2: lo2 + 1024]
                    p, q = np.nonzero(vec[x] @ vec[y].T >= cosine - 1e-9)
                    p, q = x[p], y[q]
                    keep = p < q if i == j else np.ones(len(p), dtype=bool)
                    p, q = p[keep], q[keep]
                    for s in range(0, len(p), 1 << 16):
                        pp, qq = p[s: s + (1 << 16)], q[s: s + (1 << 16)]
                        ok = np.einsum("ij,ij->i", vec[pp], vec[qq]) >= cosine
                        ok &= (sig[pp] != sig[qq]).all(axis=1)
                        pp, qq = pp[ok], qq[ok]
                        np.add.at(links, pp, many[qq])
                        np.add.at(links, qq, many[pp])
                        us.append(node[pp])
                        vs.append(node[qq])
            seen = np.flatnonzero(links)
            if not len(seen):
                return None
            n, root = forest(np.concatenate(us), np.concatenate(vs))
            return pd.DataFrame({"node": np.r_[node[seen], n], "other": pd.array([None] * len(seen) + root.tolist(), dtype="Int64"),
                                 "links": np.r_[links[seen], np.zeros(len(n), dtype=np.int64)]})

        held = None
        for part in batches:
            f = part if held is None else pd.concat([held, part], ignore_index=True)
            k = f[key].to_numpy()
            cut = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi - lo > 1 and (out := group(f.iloc[lo:hi])) is not None:
                    yield out
            held = f.iloc[cut[-1]:]
        if held is not None and len(held) > 1 and (out := group(held)) is not None:
            yield out

    return pairs.mapInPandas(scan, "node long, other long, links long")


def embedding_components(vectors: DataFrame, cosine: float = 0.95, seed: int = 42, id_col: str = "vec_id",
                         vec_col: str = "embedding") -> DataFrame:
    """One row per input row: the id, n_links (other rows linked directly), component_id (smallest id
    reachable by links, itself included) and kept (id = component_id).

    Rows link when their cosine, in doubles, is at least ``cosine`` and they share a bucket of some
    table. Equal vectors are one vector that counts as many, linked among themselves; lengths that
    differ never link. Vectors that are null, empty, zero or hold null or non-finite parts link with
    nothing. A bucket above BLOCK vectors is cut into blocks by hash and each pair of blocks is a group
    of its own, so no task holds more than two blocks. A task hands on counts and a spanning forest,
    not pairs. A null id links like any other; it is a component's id only if all are null. Repeated
    rows link with each other. Empty table: no rows."""
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    own = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("_id"), vectors[f"`{vec_col}`"].cast("array<float>" if single else "array<double>").alias("_raw"))
    for again in range(8):
        # equal directions by their hash: node stands for all rows that have it. A second hash tells whether two
        # directions share the first; then another seed is taken, so that a node is one direction
        hashed = written(_hashed(own, seed + again), "vectors")
        distinct = written(hashed.where("_ok").groupBy("node", "_h").agg(F.first("_raw").alias("_raw"), F.count(F.lit(1)).alias("many")), "distinct")
        if distinct.groupBy("node").count().where("count > 1").isEmpty():
            break
    own = hashed
    bits, tables = table_plan(distinct.count(), cosine)
    signed = distinct.withColumn("_s", _signatures(bits, tables, seed)("_raw")).select("node", "many", F.size("_raw").alias("_d"), "_s.*")
    signed = written(signed, "signed")  # vectors of different lengths share no bucket
    slots = signed.select("node", "_d", F.posexplode("code").alias("_t", "_b"))
    sizes = written(slots.groupBy("_d", "_t", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "sizes")
    sizes = bounded_broadcast(sizes, sizes.count() * 32)  # while it may go along, vectors are shuffled once
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    placed = signed.select("*", F.posexplode("code").alias("_t", "_b")).join(sizes, ["_d", "_t", "_b"])
    placed = placed.withColumn("_nb", blocks).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).select(
        "_d", "_t", "_b", F.least("_own", "_o").alias("_i"), F.greatest("_own", "_o").alias("_j"), "_own", "node", "many", "vec", "sig")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n, "_d", "_t", "_b", "_i", "_j").sortWithinPartitions("_d", "_t", "_b", "_i", "_j")
    found = written(_compare(placed, cosine, bits, "float32" if single else "float64"), "links")
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("_l"))
    root = components(found.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    nodes = own.where("_ok").groupBy("node").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_many"))
    nodes = nodes.join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = nodes.groupBy("root").agg(F.min("_low").alias("_c"))
    label = nodes.join(low, "root").select("node", "_c", (F.coalesce("_l", F.lit(0)) + F.col("_many") - 1).alias("_l"))
    out = own.select("_id", "node").join(label, "node", "left")
    comp = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("_c"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("_l", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("_id") == comp, F.lit(False)).alias("kept"))
