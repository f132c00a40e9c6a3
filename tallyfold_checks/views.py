"""Transaction views over the test tables.

A view joins only the tables its wanted columns come from: the tables have no
orphans, so leaving out a lookup changes no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold import Windows
from tallyfold.functions.numbers import AMOUNT

RETAIL = ("customerid", "invoicedate", "quantity", "unitprice", "country")
WINDOWS = Windows("1997-01-01", "1998-01-01", "1998-01-02", "1998-07-01")
PREDICTED = ("customerid", "invoicedate", "quantity", "unitprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, *columns: str, by_supplier: bool = False) -> DataFrame:
    """Order lines with what the columns need.

    What belongs to an order joins it before its lines do: there are fewer rows to move,
    and a busy customer is a smaller lump.
    """
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    if "unitprice" in columns:
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "country" in columns:
        nation = table(spark, sf_dir, "nation")
        if by_supplier:
            seller = table(spark, sf_dir, "supplier").join(
                nation, F.col("s_nationkey") == F.col("n_nationkey")
            )
            lines = lines.join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
        else:
            buyer = table(spark, sf_dir, "customer").join(
                nation, F.col("c_nationkey") == F.col("n_nationkey")
            )
            orders = orders.join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _retail_columns(columns: tuple[str, ...]) -> list[Column]:
    expressions = {
        "customerid": F.col("o_custkey").cast("string"),
        "invoicedate": F.col("o_orderdate").cast("timestamp_ntz"),
        "quantity": F.col("l_quantity").cast(AMOUNT),
        "unitprice": F.col("p_retailprice").cast(AMOUNT),
        "country": F.lower("n_name"),
    }
    return [expressions[c].alias(c) for c in columns]


def retail(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Order lines as clean transactions; the country is the customer's."""
    columns = columns or RETAIL
    return _lines(spark, sf_dir, *columns).select(*_retail_columns(columns))


def supplier_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the supplier's country, so that a customer has many."""
    return _lines(spark, sf_dir, *RETAIL, by_supplier=True).select(*_retail_columns(RETAIL))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events, which have a time of day and no country."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").cast("string").alias("customerid"),
            F.col("ts").cast("timestamp_ntz").alias("invoicedate"),
            F.lit(1).cast(AMOUNT).alias("quantity"),
            F.col("value").cast(AMOUNT).alias("unitprice"),
        )
    )


def dirty(spark: SparkSession, sf_dir: str, bad_dates: bool = False) -> DataFrame:
    """Order lines as the raw text of an invoice file, with faults set by the order key."""
    key = F.col("l_orderkey")
    moment = F.timestamp_add(
        "MINUTE", (key % 24) * 60 + key % 60, F.col("o_orderdate").cast("timestamp_ntz")
    )
    date = F.when(key % 2 == 0, F.date_format(moment, "M/d/yyyy H:mm")).otherwise(
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    )
    if bad_dates:
        date = F.when(key % 101 == 0, "some day").otherwise(date)
    quantity = F.col("l_quantity").cast(AMOUNT).cast("string")
    quantity = F.when(key % 97 == 0, "NA").when(key % 83 == 0, "abc").otherwise(quantity)
    country = F.col("n_name")
    country = F.when(key % 89 == 0, "").when(key % 5 == 0, F.lower(country)).otherwise(country)
    return _lines(spark, sf_dir, *RETAIL).select(
        key.cast("string").alias("Invoice No"),
        F.col("l_partkey").cast("string").alias("Stock Code"),
        quantity.alias("Quantity"),
        date.alias("Invoice Date"),
        F.col("p_retailprice").cast(AMOUNT).cast("string").alias("Unit Price"),
        F.col("o_custkey").cast("string").alias("Customer ID"),
        country.alias("Country"),
    )
