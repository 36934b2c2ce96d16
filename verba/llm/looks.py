"""What texts look like, measured for whole Arrow batches in numpy: counts of characters, words and lines."""

from __future__ import annotations

import numpy as np

from verba.functions.grams import code_points, row_slices
from verba.llm.textstats import SYMBOLS

STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
MARKS = ".,;:?"
ENDS = ".,;:!?\"'()[]" + SYMBOLS  # cut from the ends of a word
N_LOOKS = 11
CHUNK = 1 << 18  # bytes of text measured at once, some 50 bytes of memory for each; a longer text is by itself
UPPER, DIGIT, SYMBOL, BANG, MARK, SPACE, END, LINE = (1 << k for k in range(8))


def tables():
    """(class bits, lower case) of every code point."""
    bits, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for lo in range(0, len(bits), 1 << 14):
        for c, x in enumerate(map(chr, range(lo, min(lo + (1 << 14), len(bits)))), lo):
            if x.isupper():
                bits[c] |= UPPER
                small = x.lower()
                low[c] = ord(small) if len(small) == 1 else c
            elif x.isdecimal():
                bits[c] |= DIGIT
            elif x.istitle():
                small = x.lower()
                low[c] = ord(small) if len(small) == 1 else c
    for group, bit in ((SYMBOLS, SYMBOL), ("!", BANG), (MARKS, MARK), (" \t\n\x0b\f\r", SPACE), (ENDS, END), ("\n", LINE)):
        bits[[ord(x) for x in group]] |= bit
    return bits, low


def _mixed(h):
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _distinct(row, h):
    """Places of the first of equal hashes of a row, in order."""
    key = _mixed(h + row.astype(np.uint64) * STEP)
    return np.sort(np.unique(key, return_index=True)[1])


def looks(texts, table, buckets: int):
    """String array -> (features, a row of N_LOOKS each; buckets of the distinct words of all rows in one array;
    number of them by row). Words are split at white space; they are hashed in lower case, without ENDS at
    their ends, all by one prefix sum of powers. Null is empty."""
    out, found, many = [], [], []
    for _, part in row_slices(texts, CHUNK):
        x, b, n = _looks(part, table, buckets)
        out.append(x)
        found.append(b)
        many.append(n)
    if not out:
        return np.zeros((0, N_LOOKS)), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(found), np.concatenate(many)


def _looks(texts, table, buckets: int):
    bits, low = table
    points, start = code_points(texts)
    n, rows, total = np.diff(start), len(texts), len(points)
    of = np.repeat(np.arange(rows, dtype=np.int32), n)
    kind = bits[points]
    share = {k: np.bincount(of[(kind & k) > 0], minlength=rows) for k in (UPPER, DIGIT, SYMBOL, BANG, MARK)}
    power = np.cumprod(np.full(total + 1, STEP)) * BACK
    back = np.cumprod(np.full(total + 1, BACK)) * STEP
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low[points].astype(np.uint64) + np.uint64(1)) * power[:total])])

    def hashed(a, b):
        return _mixed((prefix[b] - prefix[a]) * back[a])

    first = np.zeros(total + 1, bool)
    first[start[:-1]] = True
    word = (kind & SPACE) == 0
    begins = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]])[:total] | word & first[:total])
    ends = np.flatnonzero(word & np.concatenate([~word[1:], [True]])[:total] | word & first[1:]) + 1
    core = np.flatnonzero((kind & (SPACE | END)) == 0)
    if len(core):
        a = core[np.minimum(np.searchsorted(core, begins), len(core) - 1)]
        b = core[np.maximum(np.searchsorted(core, ends) - 1, 0)] + 1
        none = (a >= ends) | (a < begins)
        a, b = np.where(none, begins, a), np.where(none, begins, b)
    else:
        a = b = begins
    h, row = hashed(a, b), of[begins] if total else np.zeros(0, np.int64)
    words = np.bincount(row, minlength=rows)
    one = _distinct(row, h)
    distinct = np.bincount(row[one], minlength=rows)
    stutter = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows) if len(h) else np.zeros(rows)
    # lines with a word: from the row's start or behind a line feed, to the next line feed or the row's end
    feed = np.flatnonzero(kind & LINE)
    line_a = np.unique(np.concatenate([start[:-1][n > 0], feed + 1]))
    line_a = line_a[line_a < total]
    line_b = np.minimum(np.append(feed, total)[np.searchsorted(feed, line_a)], start[1:][of[line_a]])
    full = np.searchsorted(begins, line_b) > np.searchsorted(begins, line_a)
    line_a, line_b = line_a[full], line_b[full]
    line_row = of[line_a]
    lines = np.bincount(line_row, minlength=rows)
    again = lines - np.bincount(line_row[_distinct(line_row, hashed(line_a, line_b))], minlength=rows)
    w, chars = np.maximum(words, 1), np.maximum(n, 1)
    log = np.log1p(words)
    v = distinct / w
    x = np.stack([share[UPPER] / chars, share[SYMBOL] / w, share[BANG] / w, share[DIGIT] / chars, chars / w, v, log, v * log, stutter / w,
                  again / np.maximum(lines, 1), share[MARK] / w], axis=1)
    return x, (h[one] & np.uint64(buckets - 1)).astype(np.int32), distinct
