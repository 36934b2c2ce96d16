"""DuckDB spellings of the text functions, used only to write oracle SQL.

Same patterns as ``verba.functions.text``; DuckDB's RE2 needs the 'g' flag for
a global replace, ``\\1`` for a group, and has ASCII ``\\b``/``\\d`` (no ``(?U)``).
"""

from __future__ import annotations

import unicodedata

from verba.functions import text as T

EMAIL_SQL = T.EMAIL.replace("(?U)", "")
PHONE_SQL = T.PHONE.replace("(?U)", "")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def collapse_ws(e: str) -> str:
    return f"trim({rr(e, T.WS_CLASS + '+', ' ')}, ' ')"


def clean_text(e: str) -> str:
    c = rr(e, T.WS_CLASS + "+", " ")
    c = rr(c, T.URL, "")
    c = rr(c, EMAIL_SQL, "")
    c = rr(rr(c, T.MENTION, r"\1"), T.HASHTAG, r"\1")
    c = rr(c, PHONE_SQL, "")
    c = rr(rr(rr(c, r"!{2,}", "!"), r"\?{2,}", "?"), r"\.{3,}", "...")
    c = rr(c, T.CONTROL_ASCII, "")
    return collapse_ws(c)


def _nfkd_pairs():
    # Rule: every code point in Latin-1 Supplement and Latin Extended-A whose NFKD differs.
    for cp in range(0xA0, 0x180):
        ch = chr(cp)
        d = unicodedata.normalize("NFKD", ch)
        if d != ch:
            yield ch, d


def nfkd(e: str) -> str:
    out = e
    for ch, d in _nfkd_pairs():
        out = f"replace({out}, {q(ch)}, {q(d)})"
    return out


def truncate_at_word(e: str, limit: int = T.MAX_MODEL_CHARS) -> str:
    return (
        f"(CASE WHEN length({e}) > {limit} THEN "
        f"regexp_replace(substring({e}, 1, {limit}), ' [^ ]*\\z', '') ELSE {e} END)"
    )


def normalize_text(e: str, truncate: bool = True) -> str:
    c = collapse_ws(nfkd(f"lower({e})"))
    c = f"(CASE WHEN {c} = '' THEN 'empty text' ELSE {c} END)"
    return truncate_at_word(c) if truncate else c


def word_tokens(e: str) -> str:
    return f"regexp_extract_all({e}, {q(r'[\p{L}\p{M}\p{N}_]+')})"


def char_ngrams(e: str, n: int = 3) -> str:
    return (
        f"(CASE WHEN length({e}) >= {n} THEN "
        f"list_transform(range(1, length({e}) - {n - 2}), lambda i: substring({e}, i, {n})) "
        f"ELSE []::VARCHAR[] END)"
    )
