"""Queries and DuckDB oracles for the text functions (TXT1-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verba.functions import text as T
from verba.plans import sql_text as S
from verba.sources.tables import load


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


def _docs_pages(spark, sf):
    d = load(spark, sf, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    p = load(spark, sf, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return d.unionByName(p)


_DOCS_PAGES_SQL = (
    "(SELECT 'doc' AS src, doc_id AS id, text FROM documents "
    "UNION ALL SELECT 'page' AS src, page_id AS id, html AS text FROM pages)"
)


def _phone_texts(spark, sf):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    sep = F.when(k % 3 == 0, "-").when(k % 3 == 1, ".").otherwise("")
    body = F.concat(
        F.lpad((k % 1000).cast("string"), 3, "0"), sep,
        F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), sep,
        F.lpad((k % 10000).cast("string"), 4, "0"),
    )
    tail = F.when(k % 5 == 0, "x").otherwise("")
    return o.select(k.alias("id"), F.concat(F.lit("call "), body, tail, F.lit(" now")).alias("text"))


_PHONE_SQL = """(SELECT o_orderkey AS id,
  'call ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')
  || CASE WHEN o_orderkey % 3 = 0 THEN '-' WHEN o_orderkey % 3 = 1 THEN '.' ELSE '' END
  || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0')
  || CASE WHEN o_orderkey % 3 = 0 THEN '-' WHEN o_orderkey % 3 = 1 THEN '.' ELSE '' END
  || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
  || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END || ' now' AS text FROM orders)"""


def _punct_texts(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    o = load(spark, sf, "orders").select(
        (-1 - F.col("o_orderkey")).alias("id"),
        F.concat(
            F.lit("wait"), F.repeat(F.lit("?"), (F.col("o_orderkey") % 5).cast("int")),
            F.lit(" ok"), F.repeat(F.lit("."), (F.col("o_orderkey") % 6).cast("int")),
            F.lit(" yes"), F.repeat(F.lit("!"), (F.col("o_custkey") % 4).cast("int")),
        ).alias("text"),
    )
    return d.unionByName(o)


_PUNCT_SQL = """(SELECT doc_id AS id, text FROM documents UNION ALL
  SELECT -1 - o_orderkey AS id, 'wait' || repeat('?', CAST(o_orderkey % 5 AS INTEGER)) || ' ok'
  || repeat('.', CAST(o_orderkey % 6 AS INTEGER)) || ' yes' || repeat('!', CAST(o_custkey % 4 AS INTEGER)) AS text
  FROM orders)"""


def _control_texts(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("id"),
        F.concat(
            F.lit("a"), F.chr(k % 32), F.lit("b"), F.chr(F.lit(127)), F.lit("c"),
            F.chr(128 + k % 64), F.lit(" "), F.col("event_type"),
        ).alias("text"),
    )


_CONTROL_SQL = """(SELECT event_id AS id, 'a' || chr(CAST(event_id % 32 AS INTEGER)) || 'b' || chr(127) || 'c'
  || chr(CAST(128 + event_id % 64 AS INTEGER)) || ' ' || event_type AS text FROM events)"""


def _one(fn, source="docs"):
    def q(spark, sf):
        if source == "docs":
            return _docs(spark, sf).select("doc_id", fn(F.col("text")).alias("out"))
        if source == "pages":
            return load(spark, sf, "pages").select("page_id", fn(F.col("html")).alias("out"))
        if source == "docs_pages":
            return _docs_pages(spark, sf).select("src", "id", fn(F.col("text")).alias("out"))
        builders = {"phones": _phone_texts, "punct": _punct_texts, "control": _control_texts}
        return builders[source](spark, sf).select("id", fn(F.col("text")).alias("out"))

    return q


def _sql_one(expr_fn, source="docs"):
    if source == "docs":
        return f"SELECT doc_id, {expr_fn('text')} AS out FROM documents"
    if source == "pages":
        return f"SELECT page_id, {expr_fn('html')} AS out FROM pages"
    if source == "docs_pages":
        return f"SELECT src, id, {expr_fn('text')} AS out FROM {_DOCS_PAGES_SQL} t"
    src = {"phones": _PHONE_SQL, "punct": _PUNCT_SQL, "control": _CONTROL_SQL}[source]
    return f"SELECT id, {expr_fn('text')} AS out FROM {src} t"


def _sql_punct(e):
    return S.rr(S.rr(S.rr(e, r"!{2,}", "!"), r"\?{2,}", "?"), r"\.{3,}", "...")


_SPECS = {
    "collapse_whitespace": (T.collapse_whitespace, S.collapse_ws, "docs"),
    "strip_urls": (T.strip_urls, lambda e: S.rr(e, T.URL, ""), "pages"),
    "strip_emails": (T.strip_emails, lambda e: S.rr(e, S.EMAIL_SQL, ""), "docs"),
    "unwrap_mentions_hashtags": (
        T.unwrap_mentions_hashtags, lambda e: S.rr(S.rr(e, T.MENTION, r"\1"), T.HASHTAG, r"\1"), "docs_pages"),
    "drop_mentions_hashtags": (
        T.drop_mentions_hashtags, lambda e: S.rr(S.rr(e, T.MENTION, ""), T.HASHTAG, ""), "docs_pages"),
    "strip_phones": (T.strip_phones, lambda e: S.rr(e, S.PHONE_SQL, ""), "phones"),
    "squeeze_punctuation": (T.squeeze_punctuation, _sql_punct, "punct"),
    "strip_control_chars": (T.strip_control_chars, lambda e: S.rr(e, T.CONTROL_ASCII, ""), "control"),
    "clean_text": (T.clean_text, S.clean_text, "docs_pages"),
    "lowercase_text": (T.lowercase_text, lambda e: f"lower({e})", "docs"),
    "nfkd_normalize": (T.nfkd_normalize, S.nfkd, "docs"),
    "truncate_at_word": (T.truncate_at_word, S.truncate_at_word, "docs"),
    "normalize_text": (lambda c: T.normalize_text(T.clean_text(c)), lambda e: S.normalize_text(S.clean_text(e)), "docs"),
}


def q_preview_text(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", T.preview_text("text", 100).alias("preview_100"), T.preview_text("text", 50).alias("preview_50"))


def _sql_preview(n):
    return f"CASE WHEN length(text) > {n} THEN substring(text, 1, {n}) || '...' ELSE text END"


def q_capitalize_label(spark, sf):
    e = load(spark, sf, "events")
    return e.select(
        "event_id",
        T.capitalize_label("event_type").alias("label_display"),
        F.upper(F.concat(F.substring("event_type", 1, 2))).alias("code_display"),
    )


QUERIES = {k: _one(v[0], v[2]) for k, v in _SPECS.items()}
QUERIES["preview_text"] = q_preview_text
QUERIES["capitalize_label"] = q_capitalize_label

ORACLES = {k: _sql_one(v[1], v[2]) for k, v in _SPECS.items()}
ORACLES["preview_text"] = (
    f"SELECT doc_id, {_sql_preview(100)} AS preview_100, {_sql_preview(50)} AS preview_50 FROM documents"
)
ORACLES["capitalize_label"] = (
    "SELECT event_id, upper(substring(event_type, 1, 1)) || substring(event_type, 2) AS label_display, "
    "upper(substring(event_type, 1, 2)) AS code_display FROM events"
)
