"""Monthly description of a transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyfold.operators.monthly import ALL_COUNTRIES, growth, monthly

METRICS = ("revenue", "revenue_growth", "quantity", "customers", "transactions")


def describe(
    df: DataFrame,
    metric: str,
    country: str = ALL_COUNTRIES,
    empty_means_all: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """One of ``METRICS`` per month, for one country or all; see ``monthly`` for the options."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    if metric == "revenue_growth":
        return growth(monthly(df, "revenue", country, empty_means_all))
    return monthly(df, metric, country, empty_means_all, approximate)
