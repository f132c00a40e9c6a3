"""Sketches: small summaries that are kept, merged and asked later, without a second look at the rows.

Quantiles come from KLL sketches, distinct customers from HyperLogLog ones, both Spark's own
aggregates: each task makes its sketches, and few kilobytes a group and task are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import month_of

#: A sketch of size k has a rank error of RANK_FACTOR / k ** RANK_POWER, 99 times in 100.
RANK_FACTOR, RANK_POWER = 2.296, 0.9021
SMALLEST_K, LARGEST_K = 8, 65535


def sketch_size(rank_error: float) -> int:
    """Size of a quantile sketch whose answers are off by ``rank_error`` of all rows at most, 99 times in 100."""
    if not 0 < rank_error < 1:
        raise ValueError("rank_error must lie between 0 and 1")
    k = math.ceil((RANK_FACTOR / rank_error) ** (1 / RANK_POWER))
    if k > LARGEST_K:
        raise ValueError(f"no sketch has a rank error of {rank_error}; leave it out for exact quantiles")
    return max(SMALLEST_K, k)


def quantile_sketch(column: str, rank_error: float) -> Column:
    """An aggregate: the sketch of a column's values, without nulls and what is no number."""
    value = F.col(column).cast("double")
    return F.kll_sketch_agg_double(F.when(~F.isnan(value), value), F.lit(sketch_size(rank_error)))


def quantile_sketches(df: DataFrame, column: str, by: Sequence[str], rank_error: float = 0.01) -> DataFrame:
    """(by..., sketch): a table to keep, whose rows can be merged over any of their groups."""
    return df.groupBy(*by).agg(quantile_sketch(column, rank_error).alias("sketch"))


def quantiles_of_sketches(sketches: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., probability, value) of merged sketches, see ``quantile_sketches``.

    A value is one of the column's, and its rank is as good as the sketches are. A group
    without values has null.
    """
    merged = sketches.groupBy(*by).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    return asked(merged, "sketch", probabilities, by)


def asked(groups: DataFrame, sketch: str, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The quantiles of a sketch in each row, a row for each probability."""
    cells = [
        F.struct(F.lit(float(p)).alias("probability"), quantile_of(F.col(sketch), p).alias("value")) for p in probabilities
    ]
    return groups.select(*by, F.inline(F.array(*cells)))


def quantile_of(sketch: Column, probability: float) -> Column:
    filled = F.when(F.kll_sketch_get_n_double(sketch) > 0, sketch)
    return F.kll_sketch_get_quantile_double(filled, F.lit(float(probability)))


def customer_sketches(df: DataFrame, by_country: bool = True, size: int = 14) -> DataFrame:
    """(month_start, [country,] sketch): the customers of each month and country, in a sketch of ``2 ** size`` registers.

    Their number comes with a standard error of about ``1.04 / 2 ** (size / 2)``.
    """
    keys = [month_of(F.col("invoicedate")).alias("month_start"), *(["country"] if by_country else [])]
    return df.groupBy(*keys).agg(F.hll_sketch_agg("customerid", size).alias("sketch"))


def distinct_customers_of(sketches: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """(by..., customers): distinct customers over any months and countries that ``sketches`` holds, or filters leave.

    A customer of several months or countries counts once; sums of monthly numbers would not do that.
    """
    union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*by).agg(F.coalesce(union, F.lit(0).cast("long")).alias("customers"))
