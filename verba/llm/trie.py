"""Conversation prefix trie: distinct first turns as nodes, subtree totals by centroid decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verba.llm.common import written
from verba.operators.scan import running
from verba.session import bounded_broadcast

LOCAL = 1 << 14  # nodes of a component that one task decomposes; larger ones are split by all tasks
CHUNK = 1 << 16  # bytes of joined ids in a row


def turns_in_order(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(c, i, a, b, chars): conversation, place of the turn from 0, two hashes of (role, text), code points.

    By turn, nulls first, then role, then text; null role or text is empty. Rows without a conversation id
    belong to no conversation and are left out; repeated rows are turns of their own."""
    col = lambda c: conversations[f"`{c}`"]
    said = conversations.select(col(id_col).cast("long").alias("c"), col(turn_col).alias("turn"),
                                F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
                                F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).where("c IS NOT NULL")
    lined = running(said, ["c"], ["turn", "role", "text"], {"i": ("sum", F.lit(1).cast("long"))})
    return lined.select("c", (F.col("i") - 1).alias("i"), F.xxhash64(F.lit(1), "role", "text").alias("a"),
                        F.xxhash64(F.lit(2), "role", "text").alias("b"), F.char_length("text").cast("long").alias("chars"))


def forked(turns: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % family, then c's own after its first
    h; h is crc32 of the decimal c, modulo ``heads``. turns_in_order() -> (c, n, rows): one row per
    conversation with its new length, and in a second frame its turns (c, i, a, b, chars, n)."""
    turns = written(turns, "turns")
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.col("c") - F.col("c") % family) \
        .withColumn("h", F.crc32(F.encode(F.col("c").cast("string"), "UTF-8")) % heads)
    bases = convs.where(F.col("c") % family == 0).select(F.col("c").alias("base"), F.col("n").alias("_nb"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("_nb", F.lit(0))))
    convs = written(convs.select("c", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "convs")
    own = turns.join(convs.drop("base"), "c").where("i >= h").select("c", (F.col("i") - F.col("h") + F.col("k")).alias("i"), "a", "b", "chars", "n")
    head = turns.where((F.col("c") % family == 0) & (F.col("i") < heads - 1)).withColumnRenamed("c", "base")
    head = head.join(convs, "base").where("i < k").select("c", "i", "a", "b", "chars", "n")
    return convs.select("c", "n"), own.unionByName(head)


def _nodes(convs: DataFrame, turns: DataFrame):
    """(nodes, paths): a node is (m, d), its smallest member and its depth; pm its parent's smallest member.

    A prefix is known by its depth and two 64-bit XORs of hashes that hold the place of each turn, running
    values that a segmented scan yields. S is the number of (member, turn) pairs from the node down: the
    subtree sum of the weight n_convs, which one grouping gives for all nodes. paths has a row per
    (conversation, depth): the node there, its parent and whether the conversation ends there."""
    salted = {f"x{s}": ("xor", F.xxhash64(F.lit(s), "i", "a", "b")) for s in (3, 4)}
    rows = running(turns, ["c"], ["i"], salted)
    rows = rows.select("c", (F.col("i") + 1).alias("d"), "x3", "x4", "chars", "n",
                       *[F.col(f"x{s}").bitwiseXOR(F.xxhash64(F.lit(s), "i", "a", "b")).alias(f"p{s}") for s in (3, 4)])
    rows = written(rows, "prefixes")
    found = rows.groupBy("d", "x3", "x4").agg(
        F.min("c").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.max("p3").alias("p3"), F.max("p4").alias("p4"),
        F.max("chars").alias("chars"), F.sum(F.col("n") - F.col("d") + 1).alias("S"))
    top = convs.agg(F.min("c").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("n") + 1).alias("S")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    found = written(found.unionByName(top.select(zero.alias("d"), zero.alias("x3"), zero.alias("x4"), "m", "n_convs", zero.alias("p3"),
                                                 zero.alias("p4"), zero.alias("chars"), "S")), "found")
    up = found.select((F.col("d") + 1).alias("d"), F.col("x3").alias("p3"), F.col("x4").alias("p4"), F.col("m").alias("pm"))
    nodes = written(found.join(up, ["d", "p3", "p4"], "left").drop("p3", "p4"), "nodes")
    paths = rows.join(nodes.select("d", "x3", "x4", "m", "pm"), ["d", "x3", "x4"]).select(
        "c", "d", "m", "pm", (F.col("d") == F.col("n")).alias("ends"))
    return nodes.drop("x3", "x4"), written(paths, "paths")


def _root(nodes: DataFrame) -> int | None:
    """Smallest member of the root, of which there is one or, without conversations, none."""
    row = nodes.where("d = 0").select("m").first()
    return row and row[0]


def _tops(parent):
    """Index of the topmost node above each: pointers are doubled until they settle."""
    import numpy as np

    at = np.where(parent < 0, np.arange(len(parent)), parent)
    while True:
        up = at[at]
        if np.array_equal(up, at):
            return at
        at = up


def centroid_rollup(parent, weight, values):
    """Subtree sums of a forest by centroid decomposition, all components level by level.

    parent: index of the parent, -1 at tops; weight: subtree sums of positive node weights; values: a row
    per node -> its subtree sums, the node included. In each component the nodes whose subtree holds at
    least half of the weight are the path from the top to the centroid, its last. The total of the
    centroid's subtree is added to that path; the centroid goes, and what is left falls apart into
    components of at most half of the weight."""
    import numpy as np

    parent, weight = np.array(parent, dtype=np.int64), np.array(weight, dtype=np.int64)
    out = np.zeros_like(values)
    node, own, got = np.arange(len(parent)), np.array(values), np.zeros_like(values)
    while len(node):
        n = len(node)
        top = _tops(parent)
        path = np.flatnonzero(2 * weight >= weight[top])
        by = path[np.lexsort((weight[path], top[path]))]
        cent = by[np.r_[True, top[by][1:] != top[by][:-1]]]  # the least subtree of each path
        is_cent = np.zeros(n, dtype=bool)
        is_cent[cent] = True
        cut = parent.copy()
        cut[cent] = -1
        below = _tops(cut)
        total = np.zeros_like(own)
        here = is_cent[below]
        np.add.at(total, below[here], own[here])
        out[node[cent]] = got[cent] + total[cent]
        of = np.full(n, -1)
        of[top[cent]] = cent
        path = path[~is_cent[path]]
        c = of[top[path]]
        got[path] += total[c]
        weight[path] -= weight[c]
        parent[(parent >= 0) & is_cent[parent]] = -1
        left = np.flatnonzero(~is_cent)
        new = np.full(n, -1)
        new[left] = np.arange(len(left))
        parent = np.where(parent[left] >= 0, new[parent[left]], -1)
        node, own, got, weight = node[left], own[left], got[left], weight[left]
    return out


def _split(cur: DataFrame, large: DataFrame, paths: DataFrame, values: list[str]):
    """One level for components too large for a task -> (finished centroids, nodes with new components).

    Which nodes lie under a centroid follows from the paths: a node's smallest member either passes through
    a child of the centroid, whose component the node joins, or doesn't pass through the centroid at that depth."""
    comp = ["cm", "cd"]
    big = written(cur.join(large, comp), "big")
    cents = big.where(2 * F.col("S") >= F.col("W")).groupBy(*comp).agg(F.min_by(F.struct("m", "d", "S"), "S").alias("_c"))
    cents = written(cents.select(*comp, F.col("_c.m").alias("em"), F.col("_c.d").alias("ed"), F.col("_c.S").alias("eS")), "centroids")
    few = bounded_broadcast(cents, cents.count() * 40)
    kids = paths.join(few, (paths["pm"] == F.col("em")) & (paths["d"] == F.col("ed") + 1)).select(
        *comp, F.col("c").alias("m"), F.col("m").alias("km"), F.lit(True).alias("under"))
    told = big.join(few, comp).join(kids, [*comp, "m"], "left").withColumn("cent", (F.col("m") == F.col("em")) & (F.col("d") == F.col("ed")))
    told = written(told.withColumn("under", F.coalesce("under", F.lit(False)) & (F.col("d") > F.col("ed"))), "told")
    total = told.where("under OR cent").groupBy(*comp).agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    told = told.join(bounded_broadcast(total, cents.count() * 40), comp)
    done = told.where("cent").select("m", "d", *[(F.col(f"got_{v}") + F.col(f"t_{v}")).alias(v) for v in values])
    on_path = ~F.col("under") & (2 * F.col("S") >= F.col("W"))
    rest = told.where("NOT cent").select(
        F.when(F.col("under"), F.col("km")).otherwise(F.col("cm")).alias("cm"),
        F.when(F.col("under"), F.col("ed") + 1).otherwise(F.col("cd")).alias("cd"), "m", "d", "pm",
        F.when(on_path, F.col("S") - F.col("eS")).otherwise(F.col("S")).alias("S"), *values,
        *[F.when(on_path, F.col(f"got_{v}") + F.col(f"t_{v}")).otherwise(F.col(f"got_{v}")).alias(f"got_{v}") for v in values])
    return written(done, "done"), written(rest, "rest")


def _decompose(values: list[str]):
    """mapInPandas over rows sorted by component -> (m, d, subtree sums); whole components at a time."""
    def run(batches, values=tuple(values)):
        import numpy as np
        import pandas as pd

        def solved(f):
            f = f.reset_index(drop=True)
            same = f.groupby(["cm", "cd"], sort=False).ngroup().to_numpy()
            m, d, pm = (f[c].to_numpy(dtype=np.int64) for c in ("m", "d", "up"))
            at = pd.MultiIndex.from_arrays([same, m, d])
            parent = at.get_indexer(pd.MultiIndex.from_arrays([same, pm, d - 1]))
            parent[f["pm"].isna().to_numpy()] = -1
            sums = centroid_rollup(parent, f["S"].to_numpy(), f[list(values)].to_numpy(dtype=np.int64))
            sums += f[[f"got_{v}" for v in values]].to_numpy(dtype=np.int64)
            return pd.DataFrame({"m": m, "d": d} | {v: sums[:, k] for k, v in enumerate(values)})

        held = []
        for part in batches:
            if not len(part):
                continue
            key = part[["cm", "cd"]].to_numpy()
            if held and (key[0] != held[-1][["cm", "cd"]].to_numpy()[-1]).any():
                yield solved(pd.concat(held))
                held = []
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            if len(cut):
                yield solved(pd.concat([*held, part.iloc[: cut[-1] + 1]]))
                held = []
                part = part.iloc[cut[-1] + 1:]
            held.append(part)
        if held:
            yield solved(pd.concat(held))

    return run


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """nodes (m, d, pm, S, long values) -> (m, d, their sums over the subtree), by centroid decomposition.

    A component of at most ``local`` nodes is decomposed within a task, many of them in each; larger ones
    are split by all tasks, each level halving their weight, until none is left. Only the number of
    components reaches the driver."""
    spark = nodes.sparkSession
    comp = ["cm", "cd"]
    zero = F.lit(0).cast("long")
    cur = nodes.select(F.lit(_root(nodes)).cast("long").alias("cm"), zero.alias("cd"), "m", "d", "pm", "S", *values,
                       *[zero.alias(f"got_{v}") for v in values])
    cur, finished, small = written(cur, "components"), [], []
    while True:
        sizes = written(cur.groupBy(*comp).agg(F.count(F.lit(1)).alias("_n"), F.max("S").alias("W")).where(F.col("_n") > local), "sizes")
        many = sizes.count()
        if not many:
            small.append(cur)
            break
        large = bounded_broadcast(sizes.drop("_n"), many * 32)
        small.append(cur.join(large, comp, "left_anti"))
        done, cur = _split(cur, large, paths, values)
        finished.append(done)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = small[0]
    for df in small[1:]:
        rows = rows.unionByName(df)
    rows = rows.withColumn("up", F.coalesce("pm", F.lit(0))).repartition(n, *comp).sortWithinPartitions(*comp)
    out = rows.mapInPandas(_decompose(values), "m long, d long, " + ", ".join(f"{v} long" for v in values))
    for df in finished:
        out = out.unionByName(df)
    return out


def _id_digests(ends: DataFrame) -> DataFrame:
    """(m, d, c) -> (m, d, digest): SHA-256 of a node's decimal ids, ascending, comma-joined.

    Ids are joined into rows of CHUNK bytes where range partitions hold them, by all tasks; of a node that
    a third of all conversations end at, only these few long rows meet, and the digest streams over them."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches):
        import pandas as pd

        for part in batches:
            out = []
            for (m, d), f in part.groupby(["m", "d"], sort=False):
                ids = f["c"].tolist()
                step = CHUNK // 20
                out += [(m, d, ids[k], ",".join(map(str, ids[k: k + step]))) for k in range(0, len(ids), step)]
            yield pd.DataFrame(out, columns=["m", "d", "first", "ids"])

    def digest(batches):
        import hashlib

        import pandas as pd

        key = state = None
        for part in batches:
            out = []
            for m, d, ids in zip(part["m"], part["d"], part["ids"], strict=True):
                if (m, d) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (m, d), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["m", "d", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["m", "d", "ends_sha256"])

    rows = ends.repartitionByRange(n, "m", "d", "c").sortWithinPartitions("m", "d", "c").mapInPandas(chunks, "m long, d long, first long, ids string")
    return rows.repartition(n, "m", "d").sortWithinPartitions("m", "d", "first").mapInPandas(digest, "m long, d long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of conversations (c, n turns) with their ``turns`` (c, i from 0, a, b, chars, n): one row per node.

    conv_id (the smallest member) and depth name a node. Columns: parent_conv_id (null at the root), n_convs,
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (sum over the subtree of
    (n_convs - 1) times the code points of the node's last text) and ends_sha256 (of the ids of the
    conversations that end there). Turnless conversations end at the root. No conversations: no nodes."""
    nodes, paths = _nodes(convs, turns)
    kids = nodes.where("d > 0").groupBy(F.col("pm").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, ["m", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
                    .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")), "valued")
    sums = rollup(nodes, paths, ["n_leaves", "saved_tokens"], local)
    turnless = convs.where("n = 0").select(F.lit(_root(nodes)).cast("long").alias("m"), F.lit(0).cast("long").alias("d"), "c")
    ends = paths.where("ends").select("m", "d", "c").unionByName(turnless)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, ["m", "d"]).join(_id_digests(ends), ["m", "d"], "left")
    return out.select(F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("pm").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def forked_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", family: int = 100, heads: int = 6, local: int = LOCAL) -> DataFrame:
    """prefix_trie() of the conversations that forked() rebuilds from a table of turns."""
    return prefix_trie(*forked(turns_in_order(conversations, id_col, turn_col, role_col, text_col), family, heads), local)
