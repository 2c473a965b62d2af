"""Expressions on text and row identity that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# White space that separates words, and a word.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def row_key(*columns: str) -> Column:
    """A key of the columns' contents; two passes over the same rows give equal keys, whatever ids repeat or are null."""
    return F.concat_ws(":", F.xxhash64(*columns).cast("string"), F.hash(*columns).cast("string"))


def numbered(keyed: DataFrame, key: str, nth: str) -> DataFrame:
    """Adds the number of the row among those with its key."""
    return keyed.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
