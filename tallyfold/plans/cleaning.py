"""From a raw transaction table to a clean one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyfold.errors import InvalidDataset
from tallyfold.functions.dates import DATE_FORMATS
from tallyfold.functions.text import MISSING_TOKENS
from tallyfold.operators.cleaning import (
    drop_incomplete,
    is_temporal,
    lowercase_all,
    missing_reasons,
    normalise_missing,
    normalise_names,
    parse_dates,
    require_columns,
)

#: Columns that tell of rejected rows.
REASONS, REJECTED = "missing_values", "rejected"


def clean(
    df: DataFrame,
    formats: Iterable[str] = DATE_FORMATS,
    missing: Iterable[str] = MISSING_TOKENS,
    subset: Iterable[str] | None = None,
    counts: Observation | None = None,
) -> DataFrame:
    """Drop incomplete rows, lower-case everything, tidy the names, parse the dates.

    One narrow projection over the scan. A row with a blank in any column goes,
    unless ``subset`` names the (normalised) columns that count. Names are tidied
    and checked first, so that a missing column is reported without a job.

    ``counts`` is filled by the first action on the result, in passing: ``rows`` read and
    ``dropped``, and the rows that lack a column for each reason (``null:name`` and so on, see
    ``missing_reasons``). A row that lacks several is counted for each, and once in ``dropped``.
    """
    named = require_columns(normalise_names(df))
    missing = tuple(missing)
    if counts is None:
        kept = drop_incomplete(normalise_missing(named, missing), subset)
    else:
        marked = _marked(named, missing, subset)
        found = [F.count_if(F.array_contains(REASONS, r)).alias(r) for r in _possible(named, subset)]
        some = F.size(REASONS) > 0
        marked = marked.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(some).alias("dropped"), *found)
        kept = normalise_missing(marked.filter(~some).drop(REASONS), missing)
    typed = ["invoicedate"] if is_temporal(kept, "invoicedate") else []
    return parse_dates(lowercase_all(kept, keep=typed), formats=formats)


def _marked(named: DataFrame, missing: Iterable[str], subset: Iterable[str] | None) -> DataFrame:
    """``named`` with an array of reason and column, such as "token:quantity", for all that a row lacks."""
    for reserved in (REASONS, REJECTED):
        if reserved in named.columns:
            raise InvalidDataset(f"the dataset has a column {reserved} already")
    cells = [F.concat(why, F.lit(f":{name}")) for name, why in missing_reasons(named, missing, subset).items()]
    reasons = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<string>")
    return named.withColumn(REASONS, reasons)


def _possible(named: DataFrame, subset: Iterable[str] | None) -> list[str]:
    wanted = set(named.columns if subset is None else subset)
    kinds = {f.name: ("null", "blank", "token") if isinstance(f.dataType, StringType) else ("null", "nan") for f in named.schema}
    return [f"{why}:{name}" for name, whys in kinds.items() if name in wanted for why in whys]


def clean_and_rejected(
    df: DataFrame, path: str, missing: Iterable[str] = MISSING_TOKENS, subset: Iterable[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of the cleaner's first step, from one scan: rows that are complete, and rows that are not.

    They are written to two folders of ``path`` in one pass and come back as tables. The first
    has the columns of ``df`` under their tidied names, with missing values as null; ``clean``
    turns it into clean transactions. The second has its values as they were read and, in
    ``missing_values``, what a row lacks and why.
    """
    named = require_columns(normalise_names(df))
    missing = tuple(missing)
    marked = _marked(named, missing, subset).withColumn(REJECTED, F.size(REASONS) > 0)
    marked.write.partitionBy(REJECTED).parquet(path)
    both = df.sparkSession.read.schema(marked.schema).parquet(path)
    kept = normalise_missing(both.filter(~F.col(REJECTED)).drop(REJECTED, REASONS), missing)
    return kept, both.filter(F.col(REJECTED)).drop(REJECTED)
