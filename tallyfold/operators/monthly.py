"""Monthly figures, the list of months and the list of countries.

Every figure is one aggregation by month. Months in which a chosen country sold nothing
stay in the result. Of a table at rest the months come from a scan of its dates alone, and the
country is a filter that the other scan takes with it, down to the table's folders. Where the
table is itself worked out, which would happen twice, the country is a condition inside the
aggregates of one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.errors import InvalidDataset
from tallyfold.functions.dates import SALE_MONTH, month_label, month_of
from tallyfold.functions.numbers import lenient_number, line_value
from tallyfold.functions.text import capitalise
from tallyfold.session import is_stored

ALL_COUNTRIES = "All"


def month_list(df: DataFrame) -> DataFrame:
    """The months in which anything was sold, in order."""
    return (
        df.select(month_of(F.col("invoicedate")).alias("month_start"))
        .distinct()
        .orderBy("month_start")
        .select("month_start", month_label(F.col("month_start")).alias("month"))
    )


def country_list(df: DataFrame) -> DataFrame:
    """Choices for the country filter: "All", then the countries by name."""
    countries = df.select(F.col("country").alias("name")).distinct()
    everything = df.sparkSession.range(1).select(F.lit(ALL_COUNTRIES).alias("name"))
    return (
        everything.withColumn("place", F.lit(0))
        .unionByName(countries.withColumn("place", F.lit(1)))
        .orderBy("place", "name")
        .select("name", capitalise(F.col("name")).alias("label"))
    )


def _figure(metric: str, df: DataFrame, counted: Column, approximate: bool) -> Column:
    if metric == "revenue":
        return F.sum(F.when(counted, line_value(df, lenient=True)))
    if metric == "quantity":
        return F.sum(F.when(counted, lenient_number(df, "quantity")))
    if metric == "customers":
        customer = F.when(counted, F.col("customerid"))
        return F.approx_count_distinct(customer, 0.01) if approximate else F.count_distinct(customer)
    return F.count_if(counted)


def monthly(
    df: DataFrame,
    metric: str,
    country: str = ALL_COUNTRIES,
    empty_means_all: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """``metric`` (revenue, quantity, customers or transactions) per month.

    A month without revenue or quantity holds null; customers and transactions keep
    their 0. With ``empty_means_all`` a country that occurs nowhere stands for all.
    Customers are counted exactly, which shuffles one row per customer and month, unless
    ``approximate`` asks for a sketch of each month, good to about one percent.
    """
    if metric not in ("revenue", "quantity", "customers", "transactions"):
        raise ValueError(f"unknown metric {metric}")
    if country != ALL_COUNTRIES and "country" not in df.columns:
        raise InvalidDataset("the dataset has no column country")

    if country != ALL_COUNTRIES and not empty_means_all and is_stored(df):
        return _shown(_on_spine(df, metric, country, approximate), metric)
    everything = F.lit(True)
    chosen = everything if country == ALL_COUNTRIES else F.col("country") == country
    figures = [_figure(metric, df, chosen, approximate).alias("value")]
    fallback = empty_means_all and country != ALL_COUNTRIES
    if fallback:
        figures += [
            _figure(metric, df, everything, approximate).alias("value_of_all"),
            F.count_if(chosen).alias("matches"),
        ]
    months = df.groupBy(month_of(F.col("invoicedate")).alias("month_start")).agg(*figures)
    value = F.col("value")
    if fallback:
        # One row per month by now, so the single window partition is small.
        found = F.sum("matches").over(Window.partitionBy()) > 0
        value = F.when(found, value).otherwise(F.col("value_of_all"))
    return _shown(months.withColumn("value", value), metric)


def _on_spine(df: DataFrame, metric: str, country: str, approximate: bool) -> DataFrame:
    """(month_start, value) of one country, with the months of all."""
    own = df.filter(F.col("country") == country)
    value = _figure(metric, df, F.lit(True), approximate).alias("value")
    figures = own.groupBy(month_of(F.col("invoicedate")).alias("own_month")).agg(value)
    # A table stored by month names its months: no row of it is read for them.
    month = F.col(SALE_MONTH) if SALE_MONTH in df.columns else month_of(F.col("invoicedate"))
    spine = df.select(month.alias("month_start")).distinct()
    joined = spine.join(figures, F.col("month_start").eqNullSafe(F.col("own_month")), "left").drop("own_month")
    counted = metric in ("customers", "transactions")
    return joined.withColumn("value", F.coalesce("value", F.lit(0).cast("long"))) if counted else joined


def _shown(months: DataFrame, metric: str) -> DataFrame:
    value = F.col("value")
    if metric in ("revenue", "quantity"):
        value = F.nullif(F.coalesce(value, F.lit(0)), F.lit(0)).cast("double")
    return months.select(
        "month_start",
        month_label(F.col("month_start")).alias("month"),
        value.alias(metric),
    ).orderBy("month_start")


def growth(months: DataFrame) -> DataFrame:
    """Change of monthly revenue against the first month, in percent.

    An empty first month counts as 1 for the later ones and has no growth itself.
    The window runs over one row per month.
    """
    first = F.first("revenue").over(
        Window.orderBy("month_start").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
    )
    base = F.coalesce(first, F.lit(1.0))
    return months.select(
        "month_start", "month", ((F.col("revenue") - base) / base * 100).alias("revenue_growth")
    ).orderBy("month_start")
