"""Text functions on edge strings with outputs written by hand, and their properties on every given text."""

import pytest
from pyspark.sql import functions as F

from verba.functions import text as T

CLEAN = {
    "a b c": "a b c",
    "x\x0by\x1cz\x85w": "x y z w",
    "nul\x00del\x7fc1\x80end": "nuldelc1\x80end",
    "emoji \U0001F600 ok": "emoji \U0001F600 ok",
    "@été_1 and #tag": "été_1 and tag",
    "call 555-123-4567 or 5551234567x": "call or 5551234567x",
    "see https://ex.com/a%20c, then": "see then",
    "HTTP://UPPER.example": "HTTP://UPPER.example",
    "wow!!! what?? hm.. long.....": "wow! what? hm.. long...",
    "mail me@site.org now": "mail now",
    "": "",
    "   ": "",
    "https://only.example.com/path": "",
    "tab\tnew\nline\r\n": "tab new line",
}
NORMAL = {
    "ABC  Def": "abc def",
    "ﬁne ①": "fine 1",
    "É": "é",
    "": "empty text",
    " \t ": "empty text",
    "b" * 600: "b" * 512,
    "a" * 511: "a" * 511,
    "word " * 103: ("word " * 102).strip(),
}


@pytest.mark.parametrize("op,cases", [(T.clean_text, CLEAN), (T.normalize_text, NORMAL)])
def test_edges(spark, op, cases):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string")
    got = {r.i: r.o for r in df.select("i", op("s").alias("o")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_long_url_in_both_engines(spark, duck_small):
    from verba.plans import sql_text as S

    url = "http://" + "a%20b/" * 170_000
    df = spark.createDataFrame([("x " + url + " y",)], "s string")
    assert df.select(T.strip_urls("s").alias("o")).first().o == "x  y"
    assert duck_small.execute(f"SELECT {S.rr('s', T.URL, '')} FROM (SELECT ? AS s)", ["x " + url + " y"]).fetchone()[0] == "x  y"


def test_properties_on_given_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    c = d.select(T.clean_text("text").alias("c")).where("c IS NOT NULL")
    assert c.where(F.col("c").rlike("https?://[a-z]") | F.col("c").contains("  ")).count() == 0
    assert c.where(T.clean_text("c") != F.col("c")).count() <= c.count() // 50
    n = d.select(T.normalize_text(T.clean_text("text")).alias("n"))
    assert n.where(F.length("n") > 512).count() == 0
    assert n.where(T.normalize_text("n") != F.col("n")).count() == 0


def test_ascii_rows_send_nulls_to_python(spark):
    df = spark.createDataFrame([("plain",), ("é",), (None,)], "s string")
    assert [r.o for r in df.select(T.nfkd_normalize("s").alias("o")).collect()] == ["plain", "é", None]
