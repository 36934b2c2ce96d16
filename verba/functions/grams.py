"""Numpy kernels over Arrow batches: character grams and word tokens of many texts at once.

A gram of up to three code points is packed into one long, so equal keys are equal grams: no hash of a
gram stands for it. Everything is per batch; no Python code runs per character or per gram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 3  # code points of a gram: 21 bits each
ROWS_BYTES = 1 << 20  # bytes of text that are unpacked at once; a longer text is by itself
WINDOWS = 1 << 20  # grams or tokens that are looked up at once
TABLE = 1 << 22  # entries of a table that is addressed by the gram itself
ODD = np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: pa.Array):
    """String array -> (code points of all rows in one array, start of each row and the end)."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(texts.buffers()[1], width)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0]: off[-1]]
    try:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return points, begins[off - off[0]]
    except UnicodeDecodeError:  # bytes that are no text: row by row, each bad byte replaced
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1] - off[0], off[1:] - off[0], strict=True)]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def row_slices(texts: pa.Array, limit: int | None = None):
    """(first row, slice) with at most ``limit`` (ROWS_BYTES) bytes of text, or one row."""
    limit = limit or ROWS_BYTES
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield at, texts.slice(at, k - at)
            at, total = k, 0
        total += size
    if at < len(texts):
        yield at, texts.slice(at)


def windows(texts: pa.Array):
    """(code points, place of each gram in them, row of each gram) for successive parts of a string array;
    null rows have none."""
    for first, part in row_slices(texts):
        points, start = code_points(part)
        if not len(points):
            continue
        points, row = points.astype(np.int32), np.repeat(np.arange(len(part)), np.diff(start))
        for lo in range(0, len(points) - SIZE + 1, WINDOWS):
            own = row[lo: lo + WINDOWS + SIZE - 1]
            at = np.flatnonzero(own[:len(own) - SIZE + 1] == own[SIZE - 1:])
            if len(at):
                yield points[lo: lo + len(own)], at, own[at] + first


def grams(texts: pa.Array):
    """(packed grams, row of each) for successive parts of a string array; null rows have none."""
    for points, at, owner in windows(texts):
        p = points.astype(np.int64)
        yield p[at] << 42 | p[at + 1] << 21 | p[at + 2], owner


def gram_counts(texts: pa.Array, of, n_labels: int):
    """(packed grams, label, count) for successive parts, ``of`` being each row's label: grams of the code points
    that a part has are numbered without gaps and tallied in a table while that is small."""
    for points, at, owner in windows(texts):
        alphabet, place = np.unique(points, return_inverse=True)
        a = len(alphabet)
        size = a ** 3 * n_labels
        if size >= 1 << 62:
            p = points.astype(np.int64)
            found, inverse = np.unique(p[at] << 42 | p[at + 1] << 21 | p[at + 2], return_inverse=True)
            both, n = np.unique(inverse * n_labels + of[owner], return_counts=True)
            yield found[both // n_labels], both % n_labels, n
            continue
        place = place.astype(np.int64)
        key = (((place[:-2] * a + place[1:-1]) * a + place[2:])[at]) * n_labels + of[owner]
        both, n = tally(key, size)
        gram, p = both // n_labels, alphabet.astype(np.int64)
        yield p[gram // (a * a)] << 42 | p[gram // a % a] << 21 | p[gram % a], both % n_labels, n


def tally(key, size: int):
    """(distinct keys, their counts); keys are below ``size``."""
    if size <= TABLE:
        n = np.bincount(key, minlength=1)
        both = np.flatnonzero(n)
        return both, n[both]
    return np.unique(key, return_counts=True)


def unpacked(keys) -> list[str]:
    flat = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype(np.uint32)
    text = flat.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[k: k + SIZE] for k in range(0, len(text), SIZE)]


def packed(names: list[str]):
    p = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(-1, SIZE)
    return p[:, 0] << 42 | p[:, 1] << 21 | p[:, 2]


class GramIndex:
    """Index of packed grams. While the grams' alphabet is small a table is addressed by the gram's three
    places in it; else a hash index, whose slots' keys lie side by side and are compared whole."""

    def __init__(self, keys):
        p = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF]) if len(keys) else np.zeros((3, 0), np.int64)
        self.alphabet = np.unique(p)
        a = len(self.alphabet) + 1  # 0: in no gram
        self.table, self.keys, self.order = None, keys, np.arange(len(keys))
        if a ** 3 <= TABLE:
            self.place = np.zeros(1 << 21, np.int32)
            self.place[self.alphabet] = np.arange(1, a)
            self.table = np.full(a ** 3, -1, np.int32)
            self.table[(self.place[p[0]] * a + self.place[p[1]]) * a + self.place[p[2]]] = np.arange(len(keys))
            self.a = a
            return
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        slot = self.slot(keys)
        self.order = np.argsort(slot, kind="stable")
        self.keys = keys[self.order]
        self.start = np.searchsorted(slot[self.order], np.arange((1 << (64 - int(self.shift))) + 1))

    def slot(self, keys):
        return (keys.astype(np.uint64) * ODD >> self.shift).astype(np.int64)

    def found(self, points, at):
        """Number of the gram at each place ``at`` of the code points, -1 where there is none."""
        if self.table is not None:
            q = self.place[points]
            return self.table[((q[:-2] * self.a + q[1:-1]) * self.a + q[2:])[at]]
        p = points.astype(np.int64)
        distinct, inverse = np.unique(p[at] << 42 | p[at + 1] << 21 | p[at + 2], return_inverse=True)
        place = self.find(distinct)
        return np.where(place < 0, -1, self.order[place])[inverse] if len(self.keys) else place[inverse]

    def find(self, query):
        """Place in ``keys`` of each queried gram, -1 where there is none."""
        if self.table is not None:
            q = [self.place[x] for x in (query >> 42, query >> 21 & 0x1FFFFF, query & 0x1FFFFF)]
            return self.table[(q[0] * self.a + q[1]) * self.a + q[2]]
        slot = self.slot(query)
        at, end, out = self.start[slot], self.start[slot + 1], np.full(len(query), -1)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.keys[at[live]] == query[live]
            out[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


def tokens(lists: pa.Array):
    """(distinct tokens, number of the token of each entry, row of each entry) of successive parts of an array of
    string lists: WINDOWS tokens or one row."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    end = np.cumsum(sizes)
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - sizes[lo] + WINDOWS, side="right")))
        d = lists.slice(lo, hi - lo).flatten().dictionary_encode()
        if len(d):
            yield d.dictionary.to_pylist(), np.asarray(d.indices), np.repeat(np.arange(lo, hi), sizes[lo:hi])
        lo = hi


def row_sums(owner, index, weights, n: int):
    """(sums of weights[index] by row, hits by row) where index is not -1."""
    hit = index >= 0
    owner, index = owner[hit], index[hit]
    return (np.stack([np.bincount(owner, weights[index, k], n) for k in range(weights.shape[1])], axis=1),
            np.bincount(owner, minlength=n))
