"""Counts over whole texts as column expressions, shared by the filters. Text columns must not be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def without(text, chars: str):
    return reduce(lambda t, c: F.replace(t, F.lit(c)), chars, text)


def count_of(text, chars: str):
    """Characters of ``text`` that are in ``chars``."""
    return (F.char_length(text) - F.char_length(without(text, chars))).cast("long")


def words_of(text):
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def lines_of(text):
    """\\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def repeats_in(array):
    """Elements equal to an earlier one."""
    return (F.size(array) - F.size(F.array_distinct(array))).cast("long")


def neighbours(array, f, gap: int = 1):
    """f(element, the one ``gap`` further on) for all that have one. The array is not looked up inside a
    lambda, where an optimizer may put the expression that makes it."""
    left = F.greatest(F.size(array) - gap, F.lit(0))
    return F.slice(F.zip_with(array, F.slice(array, gap + 1, left), f), 1, left)


def once():
    """True, but not deterministic: a filter on a column that uses it is not pushed below, where it would
    repeat the expressions that the column stands for."""
    return F.spark_partition_id() >= 0
