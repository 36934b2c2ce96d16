"""LNG8: a translation memory. A text of a language is translated once, by a plug-in, and remembered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verba.functions import text as T
from verba.operators import language as L
from verba.operators.plugins import translations
from verba.session import materialize
from verba.sources.commits import CommittedTable

SCHEMA = "src_key string, src_lang string, translated string"


class TranslationMemory:
    """Translations by (SHA-256 of the text, language), appended in committed batches under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = CommittedTable(spark, path, SCHEMA)

    def rows(self) -> DataFrame:
        return self.table.read()

    def learn(self, docs: DataFrame, text_col: str, lang_col: str, route: Column, make_translator: Callable, batch: str,
              batch_size: int = 16) -> DataFrame:
        """Translate what the memory lacks of the routed rows and remember it as ``batch``; returns the
        failures (src_key, src_lang, error), which are not remembered and so tried again with the next batch.

        Keys are made distinct before the translator sees a text, and those that the memory has are left out
        by an anti-join, so a text seen in many rows or batches is translated once. A blank answer is
        remembered: the original stands, and isn't asked for again."""
        asked = docs.where(route).select(L.text_key(text_col).alias("src_key"), F.col(lang_col).alias("src_lang"), F.col(text_col).alias("t"))
        asked = asked.where("src_key IS NOT NULL").groupBy("src_key", "src_lang").agg(F.first("t").alias("t"))  # equal keys, equal texts
        new = asked.join(self.rows().select("src_key", "src_lang"), ["src_key", "src_lang"], "left_anti")
        got = materialize(new.select("src_key", "src_lang", translations(make_translator, F.col("t"), F.col("src_lang"), batch_size).alias("a")))
        ok = got.where("a.error IS NULL").select("src_key", "src_lang", F.coalesce(T.strip_ws("a.translated"), F.lit("")).alias("translated"))
        self.table.append(ok, batch)
        return got.where("a.error IS NOT NULL").select("src_key", "src_lang", "a.error")

    def translate(self, docs: DataFrame, text_col: str, lang_col: str, make_translator: Callable, batch: str,
                  out: str = "translated_text") -> DataFrame:
        """``docs`` with ``out``: the translation of rows that LNG7 routes, else the text; an error keeps it too."""
        route = L.route_for_translation(lang_col)
        self.learn(docs, text_col, lang_col, route, make_translator, batch)
        return L.apply_translations(docs, self.rows(), text_col, lang_col, route, out)
