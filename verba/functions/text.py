"""Text scalar functions as Spark column expressions.

Everything except NFKD is a chain of built-in expressions, so it stays inside
whole-stage codegen. The patterns spell out Python's Unicode-aware classes
explicitly because Java's ``\\s``/``\\w``/``\\d`` are ASCII-only.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: patterns and limits that must equal the reference's behaviour ----
WS_CLASS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"      # Python's \s for str
WORD_CLASS = r"[\p{L}\p{N}_]"                  # Python's \w for str
NOT_WORD_NOT_SPACE = r"[^a-z\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"  # Python's [^\w\s]; a-z, in \p{L}, is tried first
DIGITS = r"\p{Nd}+"                            # Python's \d+
URL = r"https?://[a-zA-Z0-9$-_@.&+!*\\(),]+"  # one class ($-_ holds %): no recursion, so any length
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
PHONE_DIGITS = r"(?U)\d{3}[-.]?\d{3}[-.]?\d{4}"  # as PHONE, without its boundaries
MENTION = r"@(" + WORD_CLASS + r"+)"
HASHTAG = r"#(" + WORD_CLASS + r"+)"
CONTROL_ASCII = r"[\x00-\x1f\x7f]"             # category C with code <= 127
# A run of whitespace that is not already one plain space (same result as WS+ -> ' ', fewer rewrites).
WS_RUN = r"[\s\x0b\x1c-\x1f\x85\p{Z}]{2,}|[\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}&&[^ ]]"
MAX_TEXT_CHARS = 10000
MAX_MODEL_CHARS = 512
EMPTY_TEXT = "empty text"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def replaced(c: Column, marks: tuple, pattern: str, by: str = "") -> Column:
    """regexp_replace() on the texts that hold one of ``marks``, without which the pattern can't match: a search
    for a fixed string costs a fraction of the pattern's attempts at every character."""
    def once(v):
        holds = v.contains(marks[0])
        for m in marks[1:]:
            holds |= v.contains(m)
        return F.when(holds, F.regexp_replace(v, pattern, by)).otherwise(v)

    return bound(c, once)


def collapse_whitespace(col) -> Column:
    """TXT1: any run of Unicode whitespace -> one space, then trim."""
    return F.trim(F.regexp_replace(_c(col), WS_RUN, " "))


def strip_ws(col) -> Column:
    """Python's str.strip(): remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def strip_urls(col) -> Column:
    """TXT2"""
    return replaced(_c(col), ("://",), URL)


def strip_emails(col) -> Column:
    """TXT3"""
    return replaced(_c(col), ("@",), EMAIL)


def unwrap_mentions_hashtags(col) -> Column:
    """TXT4: @word -> word, #word -> word."""
    return replaced(replaced(_c(col), ("@",), MENTION, "$1"), ("#",), HASHTAG, "$1")


def drop_mentions_hashtags(col) -> Column:
    """TXT5: the detector's variant drops mark and word."""
    return replaced(replaced(_c(col), ("@",), MENTION), ("#",), HASHTAG)


def strip_phones(col) -> Column:
    """TXT6"""
    return bound(_c(col), lambda v: F.when(v.rlike(PHONE_DIGITS), F.regexp_replace(v, PHONE, "")).otherwise(v))


def squeeze_punctuation(col) -> Column:
    """TXT7: !! -> !, ?? -> ?, four or more dots -> ..."""
    c = replaced(_c(col), ("!!", "??"), r"([!?])\1+", "$1")  # !!+ -> !, ??+ -> ? in one pass
    return replaced(c, ("....",), r"\.{4,}", "...")


def strip_control_chars(col) -> Column:
    """TXT8: drop control characters with code <= 127; higher ones stay."""
    return F.regexp_replace(_c(col), CONTROL_ASCII, "")


def clean_text(col) -> Column:
    """TXT9: whitespace, URLs, e-mails, mentions/hashtags, phones, punctuation, controls, whitespace."""
    c = F.regexp_replace(_c(col), WS_RUN, " ")
    c = strip_urls(c)
    c = strip_emails(c)
    c = unwrap_mentions_hashtags(c)
    c = strip_phones(c)
    c = squeeze_punctuation(c)
    c = strip_control_chars(c)
    return collapse_whitespace(c)


def lowercase_text(col) -> Column:
    """TXT10"""
    return F.lower(_c(col))


PART_BYTES = 1 << 20  # bytes of text that are Python strings at once


def _by_parts(change):
    """Arrow UDF of a string function: a batch is read and written in parts, so that a worker's memory follows
    from PART_BYTES and the batch's bytes, not from Python objects of the whole batch."""
    def run(texts: pa.Array) -> pa.Array:
        from verba.functions.grams import row_slices

        parts = [pa.array([None if v is None else change(v) for v in part.to_pylist()], pa.string()) for _, part in row_slices(texts, PART_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(run, StringType())


_nfkd = _by_parts(lambda v: unicodedata.normalize("NFKD", v))
_lower_nfkd = _by_parts(lambda v: unicodedata.normalize("NFKD", v.lower()))


NON_ASCII = r"[^\x00-\x7f]"


def nfkd_normalize(col) -> Column:
    """TXT11: Unicode NFKD (no Spark built-in); Arrow-batched. Of ASCII rows only a null goes to Python."""
    c = _c(col)
    return F.coalesce(_nfkd(F.when(c.rlike(NON_ASCII), c)), c)


def lower_nfkd(col) -> Column:
    """lower then NFKD: only a null goes to Python for ASCII rows; the rest do both steps in one batch call."""
    c = _c(col)
    return F.coalesce(_lower_nfkd(F.when(c.rlike(NON_ASCII), c)), F.lower(c))


def truncate_at_word(col, limit: int = MAX_MODEL_CHARS) -> Column:
    """TXT12: over ``limit`` chars keep ``limit`` then cut at the last space (none -> keep all)."""
    c = _c(col)
    return F.when(
        F.length(c) > limit,
        F.regexp_replace(F.substring(c, 1, limit), r" [^ ]*\z", ""),
    ).otherwise(c)


def normalize_text(col, truncate: bool = True) -> Column:
    """TXT13: lower -> NFKD -> whitespace -> 'empty text' -> truncate. Training reads texts uncut."""
    def finished(c):
        return F.when(c == "", F.lit(EMPTY_TEXT)).otherwise(truncate_at_word(c) if truncate else c)

    return bound(collapse_whitespace(lower_nfkd(col)), finished)


def is_blank(col) -> Column:
    """Null, empty or whitespace-only."""
    c = _c(col)
    return c.isNull() | ~c.rlike("[^" + WS_CLASS[1:])  # ends at the first other character


def preview_text(col, n: int) -> Column:
    """TXT15: first n chars + '...' when longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def capitalize_label(col) -> Column:
    """TXT16: upper-case the first character only."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def word_tokens(col) -> Column:
    """Word tokens of model text: letters (with their combining marks), digits, underscore."""
    return F.regexp_extract_all(_c(col), F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0)


def char_ngrams(col, n: int = 3) -> Column:
    """All overlapping character n-grams, in order; none for texts shorter than n.
    One linear regex pass (a capturing lookahead), not n substring calls."""
    return F.regexp_extract_all(_c(col), F.lit("(?s)(?=(.{%d}))" % n), 1)
