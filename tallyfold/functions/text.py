"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings a CSV reader of the pandas 1.x era takes for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)


def blank_to_null(text: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """Null where the text is one of ``tokens`` (case matters, as in the reader)."""
    return F.when(~text.isin(*tokens), text)


def capitalise(text: Column) -> Column:
    """Upper-case the first letter only; ``initcap`` would touch every word."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))
