"""Recency, frequency and monetary value per customer.

All three come out of one aggregation of the transaction table. It combines on the
map side, so a customer with a third of all rows reaches the shuffle as one row per
map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.errors import InvalidDataset
from tallyfold.functions.dates import whole_days
from tallyfold.functions.numbers import line_value
from tallyfold.session import materialise

CUSTOMER = ("customerid",)


def last_purchase(df: DataFrame, keys: Sequence[str] = CUSTOMER) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("invoicedate").alias("last_purchase"))


def frequency(df: DataFrame, keys: Sequence[str] = CUSTOMER) -> DataFrame:
    """Lines (not invoices) per customer."""
    return df.groupBy(*keys).agg(F.count("invoicedate").alias("frequency"))


def monetary(df: DataFrame, keys: Sequence[str] = CUSTOMER) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(line_value(df)).cast("double").alias("monetary"))


def recency(df: DataFrame, keys: Sequence[str] = CUSTOMER) -> DataFrame:
    """Whole days from a customer's last purchase to the last one in the table."""
    return with_recency(last_purchase(df, keys)).drop("last_purchase")


def distinct_customers(df: DataFrame) -> DataFrame:
    return df.select("customerid").distinct()


def customer_countries(df: DataFrame) -> DataFrame:
    if "country" not in df.columns:
        raise InvalidDataset("the dataset has no column country")
    return df.select("customerid", "country").distinct()


def customer_totals(df: DataFrame, keys: Sequence[str] = CUSTOMER) -> DataFrame:
    """Last purchase, lines and exact money total per key, in one pass."""
    return df.groupBy(*keys).agg(
        F.max("invoicedate").alias("last_purchase"),
        F.count("invoicedate").alias("frequency"),
        F.sum(line_value(df)).alias("monetary"),
    )


def customer_country_totals(df: DataFrame) -> DataFrame:
    """One row per customer and country, each with the totals of the whole customer.

    The fact table is read and shuffled once, down to one row per pair. The window
    then only sees those pairs: a customer's group is as long as the list of
    countries they bought from, however many lines they have.
    """
    if "country" not in df.columns:
        raise InvalidDataset("the dataset has no column country")
    customer = Window.partitionBy("customerid")
    return customer_totals(df, ("customerid", "country")).select(
        "customerid",
        "country",
        F.max("last_purchase").over(customer).alias("last_purchase"),
        F.sum("frequency").over(customer).alias("frequency"),
        F.sum("monetary").over(customer).alias("monetary"),
    )


def with_recency(totals: DataFrame) -> DataFrame:
    """Add the whole days from a last purchase to the latest of all.

    The latest of all is known only after the totals are, so these are written to the
    shared folder: the transactions are read once, and the maximum comes from one
    column of the much smaller totals, as a scalar subquery.
    """
    base = materialise(totals)
    latest = base.agg(F.max("last_purchase")).scalar()
    return base.withColumn("recency", whole_days(latest, F.col("last_purchase")))


def rfm_metrics(df: DataFrame, keys: Sequence[str] = CUSTOMER) -> DataFrame:
    """Recency, frequency and monetary value per key, without clusters."""
    return with_recency(customer_totals(df, keys)).select(
        *keys, "recency", "frequency", F.col("monetary").cast("double").alias("monetary")
    )


def rfm_by_country(df: DataFrame) -> DataFrame:
    """The metrics of the whole customer beside each of their countries."""
    return with_recency(customer_country_totals(df)).select(
        "customerid",
        "country",
        "recency",
        "frequency",
        F.col("monetary").cast("double").alias("monetary"),
    )
