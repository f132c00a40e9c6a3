"""Column names that do not clash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores after it until it is none of ``taken``, whatever their case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns of these names, which others take."""
    return df.select(*[df[f"`{c}`"] for c in df.columns if c not in names])
