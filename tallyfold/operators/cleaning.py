"""The steps of the cleaner, each usable on its own."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from tallyfold.errors import InvalidDataset
from tallyfold.functions.dates import DATE_FORMATS, parse_date
from tallyfold.functions.text import MISSING_TOKENS, blank_to_null

# Checked in this order; the first one absent is named in the error.
REQUIRED_COLUMNS = ("unitprice", "invoicedate", "customerid", "quantity")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def normalise_missing(df: DataFrame, tokens: Iterable[str] = MISSING_TOKENS) -> DataFrame:
    """Turn the usual spellings of "missing" into nulls, in text columns only."""
    tokens = tuple(tokens)
    return df.select(
        *[
            blank_to_null(_quoted(f.name), tokens).alias(f.name)
            if isinstance(f.dataType, StringType)
            else _quoted(f.name)
            for f in df.schema
        ]
    )


def has_missing(df: DataFrame, subset: Iterable[str] | None = None) -> Column:
    """True for a row in which any of the columns is null or not a number."""
    fields = [f for f in df.schema if subset is None or f.name in set(subset)]
    tests = []
    for f in fields:
        tests.append(_quoted(f.name).isNull())
        if f.dataType.typeName() in ("double", "float"):
            tests.append(F.isnan(_quoted(f.name)))
    return reduce(or_, tests, F.lit(False))


def missing_reasons(
    df: DataFrame, tokens: Iterable[str] = MISSING_TOKENS, subset: Iterable[str] | None = None
) -> dict[str, Column]:
    """For each column (of ``subset``, by default of all) why a row lacks it: null if it does not.

    "null"; "blank" and "token" for text that is a spelling of "missing"; "nan".
    """
    spelled = {"blank": [t for t in tokens if not t.strip()], "token": [t for t in tokens if t.strip()]}
    wanted = set(df.columns if subset is None else subset)
    out = {}
    for f in df.schema:
        if f.name not in wanted:
            continue
        column = _quoted(f.name)
        why = F.when(column.isNull(), "null")
        if isinstance(f.dataType, StringType):
            for reason, texts in spelled.items():
                why = why.when(column.isin(*texts), reason) if texts else why
        if f.dataType.typeName() in ("double", "float"):
            why = why.when(F.isnan(column), "nan")
        out[f.name] = why
    return out


def drop_incomplete(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Keep the rows that have every value (of ``subset``, by default of all columns)."""
    return df.filter(~has_missing(df, subset))


def incomplete_rows(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """The rows that ``drop_incomplete`` rejects."""
    return df.filter(has_missing(df, subset))


def lowercase_all(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Every column as lower-case text, except those in ``keep``."""
    keep = set(keep)
    return df.select(
        *[
            _quoted(c) if c in keep else F.lower(_quoted(c).cast("string")).alias(c)
            for c in df.columns
        ]
    )


def normalise_name(name: str) -> str:
    return name.replace(" ", "").lower()


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names without spaces, in lower case."""
    names = [normalise_name(c) for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise InvalidDataset(f"columns that differ only in spaces or case: {', '.join(repeated)}")
    return df.toDF(*names)


def require_columns(df: DataFrame, columns: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """``df`` itself, or an error that names the first column it lacks."""
    for name in columns:
        if name not in df.columns:
            raise InvalidDataset(f"the dataset has no column {name}; please provide one")
    return df


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (TimestampNTZType, TimestampType, DateType))


def parse_dates(
    df: DataFrame,
    column: str = "invoicedate",
    formats: Iterable[str] = DATE_FORMATS,
    strict: bool = True,
) -> DataFrame:
    """``column`` as wall-clock time; a date column that is typed at rest is only cast.

    A ``timestamp`` with a zone becomes the wall-clock time of the session's zone.
    """
    if is_temporal(df, column):
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    text = F.col(column)
    parsed = parse_date(text, formats)
    if strict:
        message = F.concat(F.lit(f"column {column} holds text that is no date: "), text)
        parsed = F.coalesce(
            parsed, F.when(text.isNotNull(), F.raise_error(message).cast("timestamp_ntz"))
        )
    return df.withColumn(column, parsed)
