"""Date windows and the revenue of a later one."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from tallyfold.functions.dates import SALE_MONTH, wall_clock
from tallyfold.functions.numbers import line_value


@dataclass(frozen=True)
class Windows:
    """Two half-open date windows: customers are scored in one, valued in the other."""

    rfm_start: str
    rfm_end: str
    pred_start: str
    pred_end: str

    def __post_init__(self) -> None:
        days = {}
        for name in ("rfm_start", "rfm_end", "pred_start", "pred_end"):
            try:
                days[name] = datetime.date.fromisoformat(getattr(self, name))
            except (TypeError, ValueError):
                raise ValueError(f"{name} must be a date such as 2011-06-01") from None
        if days["rfm_start"] >= days["rfm_end"]:
            raise ValueError("rfm_end must be later than rfm_start")
        if days["pred_start"] <= days["rfm_end"]:
            raise ValueError("pred_start must be later than rfm_end")
        if days["pred_start"] >= days["pred_end"]:
            raise ValueError("pred_end must be later than pred_start")

    @property
    def scored(self) -> Column:
        return in_window(self.rfm_start, self.rfm_end)

    @property
    def valued(self) -> Column:
        return in_window(self.pred_start, self.pred_end)


def in_window(start: str, end: str) -> Column:
    """True from the start of the first day until before the start of the last."""
    moment = F.col("invoicedate")
    return (moment >= wall_clock(start)) & (moment < wall_clock(end))


def in_months(df: DataFrame, start: str, end: str) -> Column:
    """True for the months that a window touches, where ``df`` has a folder for each month; else always."""
    if SALE_MONTH not in df.columns or not isinstance(df.schema[SALE_MONTH].dataType, DateType):
        return F.lit(True)
    first, last = (F.lit(datetime.date.fromisoformat(day)) for day in (start, end))
    return (F.col(SALE_MONTH) >= F.trunc(first, "month")) & (F.col(SALE_MONTH) < last)


def window_slice(df: DataFrame, start: str, end: str) -> DataFrame:
    """The rows of a window; of a table stored by month only the folders that it touches are read."""
    return df.filter(in_months(df, start, end) & in_window(start, end))


def future_revenue(df: DataFrame, start: str, end: str) -> DataFrame:
    """Revenue per customer inside a window."""
    return (
        window_slice(df, start, end)
        .groupBy("customerid")
        .agg(F.sum(line_value(df)).cast("double").alias("future_revenue"))
    )


def with_future_revenue(customers: DataFrame, revenue: DataFrame) -> DataFrame:
    """Every customer with their future revenue, 0 for those who did not come back."""
    return customers.join(revenue, "customerid", "left").na.fill(0, subset=["future_revenue"])


def two_window_totals(df: DataFrame, windows: Windows) -> DataFrame:
    """Totals of the first window and revenue of the second, per customer of the first.

    The same rows as joining two slices, from one scan that is pruned to both
    windows and one shuffle.
    """
    value = line_value(df)
    scored, valued = windows.scored, windows.valued
    months = in_months(df, windows.rfm_start, windows.rfm_end) | in_months(df, windows.pred_start, windows.pred_end)
    return (
        df.filter(months)
        .filter(scored | valued)
        .groupBy("customerid")
        .agg(
            F.max(F.when(scored, F.col("invoicedate"))).alias("last_purchase"),
            F.count(F.when(scored, F.col("invoicedate"))).alias("frequency"),
            F.sum(F.when(scored, value)).alias("monetary"),
            F.coalesce(F.sum(F.when(valued, value)), F.lit(0)).alias("future_revenue"),
        )
        .filter(F.col("frequency") > 0)
    )
