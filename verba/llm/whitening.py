"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import written

FAN = 16  # blocks that a task merges
EPS = 2.0 ** -52


def bidiagonal(r):
    """Householder: square r = U B V' -> (diagonal of B, its superdiagonal, V)."""
    import numpy as np

    a = np.array(r, dtype=np.float64)
    d = len(a)
    v = np.eye(d)

    def reflector(x):
        """(w, beta): x - beta w (w'x) is a multiple of the first unit vector."""
        w, tail = x.copy(), np.abs(x[1:]).max(initial=0.0)
        if tail == 0:
            return w, 0.0
        scale = max(abs(x[0]), tail)
        w /= scale
        norm = np.sqrt(w @ w)
        w[0] += np.copysign(norm, w[0])
        return w, 2.0 / (w @ w)

    for k in range(d):
        w, beta = reflector(a[k:, k])
        if beta:
            a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w, beta = reflector(a[k, k + 1:])
            if beta:
                a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= beta * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(diag, sup):
    """Squares of the singular values of an upper bidiagonal matrix, falling, by the differential quotient
    difference algorithm with shifts: no subtraction but of the shift, so small values are as accurate,
    relative to themselves, as large ones. A shift that turns out above the least value is taken back."""
    q, e = [float(x) * float(x) for x in diag], [float(x) * float(x) for x in sup] + [0.0]
    found, parts = [], [(q, e, 0.0)]
    while parts:
        q, e, moved = parts.pop()
        calm = 0  # passes without progress: then no shift
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + moved)
                break
            if e[n - 2] <= EPS * EPS * (q[n - 1] + moved) or e[n - 2] <= 1e-300:
                found.append(q.pop() + moved)
                e.pop()
                e[-1], calm = 0.0, 0
                continue
            if n == 2:
                a, b, c = q[0], q[1], e[0]  # eigenvalues of [[a, sqrt(ac)], [sqrt(ac), b + c]]
                s = a + b + c
                big = (s + (max(0.0, (a - b + c) * (a - b + c) + 4 * b * c)) ** 0.5) / 2
                found += [big + moved, (a * b / big if big else 0.0) + moved]
                break
            split = next((k for k in range(n - 3, -1, -1) if e[k] <= EPS * EPS * min(q[k], q[k + 1])), None)
            if split is not None:
                parts.append((q[: split + 1], [*e[:split], 0.0], moved))
                q, e = q[split + 1:], e[split + 1:]
                continue
            if 1.5 * q[0] < q[n - 1]:  # the least value should come out at the end
                q, e = q[::-1], [*e[n - 2::-1], 0.0]
            s = 0.0
            if calm < 40 * n:
                a, b, c = q[n - 2], q[n - 1], e[n - 2]
                t = a + b + c
                big = (t + (max(0.0, (a - b + c) * (a - b + c) + 4 * b * c)) ** 0.5) / 2
                low = a * b / big if big else 0.0
                s = max(0.0, low - (c * (e[n - 3] / max(a, 1e-300)) if n > 2 else 0.0) ** 0.5) * (1 - 4 * EPS)
            for attempt in range(5):
                nq, ne, d, least = [0.0] * n, [0.0] * n, q[0] - s, q[0] - s
                for k in range(n - 1):
                    nq[k] = d + e[k]
                    if d < 0 or nq[k] <= 0:
                        least = -1.0
                        break
                    t = q[k + 1] / nq[k]
                    ne[k] = e[k] * t
                    d = d * t - s
                    least = min(least, d)
                else:
                    nq[n - 1] = d
                if least >= 0 or s == 0:
                    break
                s = s / 4 if attempt < 3 else 0.0
            q, e, moved, calm = nq, ne, moved + s, calm + 1
            if s == 0 and q[n - 1] <= 1e-300:  # a zero value
                q[n - 1], e[n - 2] = 0.0, 0.0
    return sorted((max(x, 0.0) for x in found), reverse=True)


def twisted(diag, sup, lam: float):
    """Right singular vector of the bidiagonal matrix for the squared value ``lam``: B'B - lam = LDL' from the
    top and = UDU' from the bottom, joined where the twist's pivot is least, then two short recurrences."""
    import numpy as np

    n = len(diag)
    if n == 1:
        return np.ones(1)
    d, l = diag * diag, np.append(sup / diag[:-1], 0.0)
    tiny = EPS * EPS * (d.max() + lam)
    s, down = np.zeros(n), np.zeros(n)  # from the top: shifts and multipliers
    s[0] = -lam
    for k in range(n - 1):
        pivot = d[k] + s[k]
        pivot = pivot if abs(pivot) > tiny else np.copysign(tiny, pivot)
        down[k] = d[k] * l[k] / pivot
        s[k + 1] = down[k] * l[k] * s[k] - lam
    p, up = np.zeros(n), np.zeros(n)  # from the bottom
    p[n - 1] = d[n - 1] - lam
    for k in range(n - 2, -1, -1):
        pivot = d[k] * l[k] * l[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else np.copysign(tiny, pivot)
        t = d[k] / pivot
        up[k] = l[k] * t
        p[k] = p[k + 1] * t - lam
    r = int(np.argmin(np.abs(s + p + lam)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
        if abs(z[k + 1]) > 1e150:
            z /= 1e150
    return z / np.sqrt(z @ z)


def _together(diag, sup, lams, vectors):
    """Vectors of a cluster of values, for which single twisted vectors need not be orthogonal: their span is
    refined by inverse iteration on B'B and diagonalised within."""
    import numpy as np

    n = len(diag)
    b = np.diag(diag) + np.diag(sup, 1)
    t = b.T @ b
    x = np.linalg.qr(np.stack(vectors, axis=1) + 1e-4 * np.random.default_rng(0).standard_normal((n, len(vectors))))[0]
    shift = float(np.mean(lams)) + 4 * EPS * t.max()
    for _ in range(3):
        x = np.linalg.qr(np.linalg.solve(t - shift * np.eye(n) + EPS * EPS * np.eye(n), x))[0]
    w, y = np.linalg.eigh(x.T @ t @ x)
    return [x @ y[:, k] for k in np.argsort(-w)]


def right_vectors(r):
    """Square r -> (squared singular values, falling; right singular vectors as columns), by the method above."""
    import numpy as np

    scale = np.abs(r).max(initial=0.0)
    if scale == 0:
        return np.zeros(len(r)), np.eye(len(r))
    a, b, v = bidiagonal(r / scale)
    n = len(a)
    big = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < EPS * EPS * big, np.copysign(EPS * EPS * big, a), a)
    loose = np.abs(b) <= EPS / 8 * (np.abs(a[:-1]) + np.abs(a[1:]))
    cuts = [0, *(np.flatnonzero(loose) + 1).tolist(), n]
    values, columns = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        q, e = a[lo:hi], b[lo: hi - 1]
        lams = dqds(q, e)
        vecs = [twisted(q, e, lam) for lam in lams]
        k = 0
        while k < len(lams):
            end = k + 1
            while end < len(lams) and lams[end - 1] - lams[end] <= 1e-7 * lams[end - 1]:
                end += 1
            if end - k > 1:
                vecs[k:end] = _together(q, e, lams[k:end], vecs[k:end])
            k = end
        for lam, z in zip(lams, vecs, strict=True):
            whole = np.zeros(n)
            whole[lo:hi] = z
            values.append(lam)
            columns.append(v @ whole)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * scale * scale, np.stack(columns, axis=1)[:, order]


def points(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _x array<long>, _d): usable vectors as whole numbers floor(64 c) + 1000000, and their length."""
    own = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("_id"), vectors[f"`{vec_col}`"].cast("array<double>").alias("_v"))
    bad = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0 ** 56)))
    own = own.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.coalesce(bad, F.lit(True)))
    return own.select("_id", F.transform("_v", lambda c: F.floor(c * 64) + F.lit(1000000)).alias("_x"), F.size("_v").alias("_d"))


def _by_length(batch):
    """Arrow batch of points() -> (length, row numbers, matrix of longs) for each length in it."""
    import numpy as np

    d, x = batch.column("_d").to_numpy(zero_copy_only=False), batch.column("_x")
    flat, start = x.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(d)]
    for size in np.unique(d).tolist():
        at = np.flatnonzero(d == size)
        yield size, at, flat[start[at][:, None] + np.arange(size)]


def sums(pts: DataFrame) -> dict:
    """length -> (n, exact sums per dimension); a row per length, dimension and task is shuffled."""
    def partial(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for size, at, x in _by_length(batch):
                n, s = total.get(size, (0, [0] * size))
                wide = float(np.abs(x).max()) * len(at) >= 2.0 ** 62
                total[size] = n + len(at), [a + int(b) for a, b in zip(s, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        rows = [(size, j, n, str(v)) for size, (n, s) in total.items() for j, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))],
                                         names=["d", "j", "n", "s"])

    got = pts.select("_x", "_d").mapInArrow(partial, "d int, j int, n long, s string").groupBy("d", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d", "j").collect()
    out: dict = {}
    for r in got:
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _centred(x, n: int, total):
    """Rows minus the mean, in doubles: the mean's whole part goes exactly, before the conversion."""
    import numpy as np

    whole = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([(s - s // n * n) / n for s in total])
    return (x - whole).astype(np.float64) - rest


def merged(blocks: DataFrame, merge) -> list:
    """(d, k, v binary) -> the one block of each d, by rounds that merge FAN blocks a task."""
    schema = "d int, k long, v binary"
    kinds = blocks.select("d").distinct().count()
    while blocks.count() > kinds:
        group = blocks.withColumn("k", F.floor(F.col("k") / FAN))
        blocks = written(group.groupBy("d", "k").applyInPandas(merge, schema), "merged")
    return blocks.collect()


def triangles(pts: DataFrame, stats: dict) -> dict:
    """length -> R of a QR factorisation of all centred rows: each task reduces its rows block by block to one
    triangle, and triangles are merged in rounds."""
    def reduce(batches, stats=stats):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict = {}
        for batch in batches:
            for size, _, x in _by_length(batch):
                r = held.get(size, np.zeros((0, size)))
                held[size] = np.linalg.qr(np.vstack([r, _centred(x, *stats[size])]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(held), pa.int64()),
                                          pa.array([r.tobytes() for r in held.values()], pa.binary())], names=["d", "k", "v"])

    def merge(f):
        import numpy as np
        import pandas as pd

        d = int(f["d"].iloc[0])
        r = np.linalg.qr(np.vstack([np.frombuffer(v).reshape(-1, d) for v in f["v"]]), mode="r")
        return pd.DataFrame({"d": [d], "k": [f["k"].iloc[0]], "v": [r.tobytes()]})

    import numpy as np

    blocks = written(pts.select("_x", "_d").mapInArrow(reduce, "d int, k long, v binary"), "triangles")
    out = {}
    for row in merged(blocks, merge):
        r = np.frombuffer(row["v"]).reshape(-1, row["d"])
        out[row["d"]] = np.vstack([r, np.zeros((row["d"] - len(r), row["d"]))])
    return out


def fit(pts: DataFrame, components: int = 32) -> dict:
    """length -> n, sums, directions (a column per component, over the root of its variance) and shares of the
    trace. What reaches the driver is a triangle per length of vector. Components without variance beyond
    rounding have no direction."""
    import numpy as np

    stats = sums(pts)
    model = {}
    for size, r in (triangles(pts, stats) if stats else {}).items():
        n, total = stats[size]
        squares, v = right_vectors(r)
        use = min(components, int((squares > squares.max(initial=0.0) * (8 * size * EPS) ** 2).sum()))
        v = v[:, :use] * np.sign(v[np.abs(v[:, :use]).argmax(axis=0), np.arange(use)])
        model[size] = {"n": n, "sums": total, "directions": v / np.sqrt(squares[:use] / n), "explained": squares[:use] / squares.sum() if use else squares[:0]}
    return model


def whitened_error(pts: DataFrame, model: dict) -> dict:
    """length -> largest entry of |covariance of the whitened rows - identity|; moments are centred per
    block and merged in rounds."""
    import numpy as np

    def pooled(a, b):
        """Merge (n, mean, centred second moment) of two blocks."""
        n = a[0] + b[0]
        step = b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    def pack(m):
        return np.concatenate([[float(m[0])], m[1], m[2].ravel()]).tobytes()

    def unpack(v):
        x = np.frombuffer(v)
        c = round((-1 + (1 + 4 * (len(x) - 1)) ** 0.5) / 2)
        return x[0], x[1: 1 + c], x[1 + c:].reshape(c, c)

    def moments(batches, model=model):
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict = {}
        for batch in batches:
            for size, _, x in _by_length(batch):
                m = model[size]
                w = _centred(x, m["n"], m["sums"]) @ m["directions"]
                mean = w.mean(axis=0)
                one = len(w), mean, (w - mean).T @ (w - mean)
                held[size] = pooled(held[size], one) if size in held else one
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(held), pa.int64()),
                                          pa.array([pack(m) for m in held.values()], pa.binary())], names=["d", "k", "v"])

    def merge(f):
        from functools import reduce

        import pandas as pd

        return pd.DataFrame({"d": [f["d"].iloc[0]], "k": [f["k"].iloc[0]], "v": [pack(reduce(pooled, map(unpack, f["v"])))]})

    blocks = written(pts.select("_x", "_d").mapInArrow(moments, "d int, k long, v binary"), "moments")
    out = {}
    for row in merged(blocks, merge):
        n, _, second = unpack(row["v"])
        out[row["d"]] = float(np.abs(second / n - np.eye(len(second))).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component (from 1 by falling variance), n, deviation (exact
    sum of (n x - S)^2; null where a long can't hold it), whitened, explained, identity_error.

    Vectors that are null, empty or hold null, non-finite or (2^56 or more) unholdable parts are left out; ids
    may be null or repeat, and repeated rows count as often as they occur. Vectors of different lengths are
    spaces of their own, each with its fit. A component without variance (constant or dependent dimensions,
    fewer rows than dimensions, a single row) can't be whitened and yields no rows. Empty table: no rows.
    Rows are read in blocks, nothing is shuffled but sums, triangles and moments of blocks."""
    pts = points(vectors, id_col, vec_col)
    model = fit(pts, components)
    errors = whitened_error(pts, model) if model else {}

    def rows(batches, model=model, errors=errors):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("_id")
            for size, at, x in _by_length(batch):
                m = model[size]
                n, use = m["n"], m["directions"].shape[1]
                if not use:
                    continue
                c = _centred(x, n, m["sums"])
                w = c @ m["directions"]
                rough = (c * c).sum(axis=1) * float(n) * float(n)
                dev = []
                if rough.max() < 2.0 ** 62 and float(np.abs(x).max()) * n < 2.0 ** 62:
                    gap = x * n - np.array(m["sums"], dtype=np.int64)
                    dev = (gap * gap).sum(axis=1).tolist()
                else:
                    for one in x.tolist():
                        exact = sum((n * a - s) ** 2 for a, s in zip(one, m["sums"], strict=True))
                        dev.append(exact if exact < 1 << 63 else None)
                k = len(at)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(at, use))), pa.array(np.tile(np.arange(1, use + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * use, n)), pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(k), use))), pa.array(w.ravel()),
                    pa.array(np.tile(m["explained"], k)), pa.array(np.full(k * use, errors[size]))],
                    names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = pts.mapInArrow(rows, schema)
    return out.select(F.col("_id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
