"""Words and word shingles as column expressions.

Arrays are built step by step with ``withColumn`` and combined element by element: a lambda
that reached for another array would have Spark compute that array again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, as regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
NOT_ALPHANUMERIC = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_between(text: Column, separators: str) -> Column:
    """The words of a text as an array; none for null."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def from_the(column: str, k: int) -> Column:
    """The array from its element ``k`` on, counted from 0."""
    return F.slice(column, k + 1, F.greatest(F.size(column) - k, F.lit(0)))


def with_shingles(df: DataFrame, words: str, width: int, name: str) -> DataFrame:
    """``df`` with an array ``name``: a 64-bit hash of each ``width`` words in a row, none for shorter texts.

    ``words`` names an array column of the words' own hashes.
    """
    df, done = df.withColumn(name, F.col(words)), 1
    while done < width:  # twice as many words, while they are as many as that, else one more
        other, step = (name, done) if 2 * done <= width else (words, 1)
        df = df.withColumn("__next", from_the(other, done))
        df = df.withColumn(name, F.zip_with(name, "__next", lambda a, b: F.xxhash64(a, b)))
        done += step
    count = F.greatest(F.size(words) - (width - 1), F.lit(0))
    return df.withColumn(name, F.slice(name, 1, count)).drop("__next")
