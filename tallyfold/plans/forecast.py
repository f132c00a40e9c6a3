"""Customers of one date window and their value in a later one."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf, nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.errors import InvalidDataset
from tallyfold.functions.numbers import exact
from tallyfold.operators.buckets import ValueBuckets, histogram
from tallyfold.operators.clusters import STARTS, assign, fit_lloyd
from tallyfold.operators.quantiles import cluster_quantiles, column_quantiles, trim_limit
from tallyfold.operators.rfm import with_recency
from tallyfold.operators.sketches import quantile_of, quantile_sketch
from tallyfold.operators.windows import Windows, two_window_totals
from tallyfold.plans.segments import CLUSTERS, METRICS, labelled, segment_columns

TARGET = "future_revenue"
QUARTILES = (0.25, 0.5, 0.75)
# Fixed value: what a report says when nothing went wrong.
DONE = "Successfully predicted values"


def customer_value(
    df: DataFrame,
    windows: Windows,
    trim: float = 0.99,
    k: int = 3,
    starts: Sequence[str] = STARTS,
) -> DataFrame:
    """All customers of the first window with segment, future revenue and value cluster.

    The value cluster is null for those the outlier trim leaves out. One scan of the
    fact table; one histogram of all four figures serves both clusterings and the
    trim, which only cuts off the top of the revenue histogram.
    """
    return _valued(df, windows, trim, k, starts)[0]


def _valued(
    df: DataFrame,
    windows: Windows,
    trim: float,
    k: int,
    starts: Sequence[str],
    probabilities: Sequence[float] = (),
) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """``customer_value``, and quantiles of the value clusters as (cluster, probability, value).

    A cluster is a range of the revenue histogram, so its quantiles are ranks of that.
    """
    base = with_recency(two_window_totals(df, windows))
    revenue = len(METRICS)
    with ValueBuckets(histogram(base, [*METRICS, TARGET])) as buckets:
        if not buckets.series:
            raise InvalidDataset("there are no customers in the first window")
        scored = fit_lloyd(buckets, {i: CLUSTERS for i in range(revenue)}, starts)
        limit = trim_limit(buckets, revenue, trim, TARGET)
        highest = nextafter(limit, -inf)
        buckets.settle({revenue: [highest]})
        buckets.cut(revenue, highest)
        valued = fit_lloyd(buckets, {revenue: k}, starts)[revenue]
        quantiles = cluster_quantiles(buckets, revenue, valued, probabilities)
    users = labelled(base, scored, "window")
    users = assign(users, TARGET, "ltv_cluster", valued)
    kept = F.col(TARGET).cast("double") < limit
    users = users.select(
        "customerid",
        *segment_columns(),
        F.col(TARGET).cast("double"),
        F.when(kept, F.col("ltv_cluster")).alias("ltv_cluster"),
    )
    return users, quantiles


def future_value(
    df: DataFrame,
    rfm_start: str,
    rfm_end: str,
    pred_start: str,
    pred_end: str,
    trim: float = 0.99,
    k: int = 3,
    starts: Sequence[str] = STARTS,
) -> DataFrame:
    """The customers that the trim keeps, with their value cluster."""
    windows = Windows(rfm_start, rfm_end, pred_start, pred_end)
    return customer_value(df, windows, trim, k, starts).filter(F.col("ltv_cluster").isNotNull())


def ltv_counts(ltv: DataFrame) -> DataFrame:
    return ltv.groupBy("ltv_cluster").agg(F.count("customerid").alias("customers"))


def ltv_revenue(ltv: DataFrame) -> DataFrame:
    return ltv.groupBy("ltv_cluster").agg(F.sum(exact(TARGET)).cast("double").alias(TARGET))


def _statistics(value: str = TARGET) -> dict[str, Column]:
    """Description of a cluster but for its quartiles; a single customer deviates by 0."""
    return {
        "count": F.count(value).cast("double"),
        "mean": F.avg(exact(value)).cast("double"),
        "std": F.coalesce(F.stddev_samp(value), F.lit(0.0)),
        "min": F.min(value).cast("double"),
        "max": F.max(value).cast("double"),
    }


def _quartiles(ltv: DataFrame, by: str = "ltv_cluster", value: str = TARGET) -> DataFrame:
    """Exact quartiles per cluster, from the value histogram."""
    found = column_quantiles(ltv, value, QUARTILES, by)
    percent = F.format_number(F.col("probability") * 100, 0)
    return found.select(by, F.concat(percent, F.lit("%")).alias("stat"), "value")


def ltv_describe(
    ltv: DataFrame, by: str = "ltv_cluster", value: str = TARGET, rank_error: float | None = None
) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per cluster, as (cluster, stat, value).

    Quartiles are exact, which takes passes of their own; with ``rank_error`` they come from
    sketches, in the pass of the other figures.
    """
    statistics = _statistics(value)
    if rank_error is not None:
        wide = ltv.groupBy(by).agg(*[c.alias(n) for n, c in statistics.items()], quantile_sketch(value, rank_error).alias("sketch"))
        quartiles = {f"{100 * p:.0f}%": quantile_of(F.col("sketch"), p) for p in QUARTILES}
        every = {n: F.col(n) for n in statistics} | quartiles
        return wide.select(by, F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), c.alias("value")) for n, c in every.items()])))
    wide = ltv.groupBy(by).agg(*[c.alias(n) for n, c in statistics.items()])
    cells = [F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in statistics]
    return wide.select(by, F.inline(F.array(*cells))).unionByName(_quartiles(ltv, by, value))


def _cell(section: str, key: Column, stat: str, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        key.cast("string").alias("key"),
        F.lit(stat).alias("stat"),
        value.cast("double").alias("value"),
    )


def _cluster_cells() -> Column:
    key = F.col("ltv_cluster")
    return F.array(
        _cell("prediction_customer_count", key, "", F.col("customers")),
        _cell("prediction_ltv_revenue", key, "", F.col("revenue")),
        *[_cell("prediction_ltv_description", key, n, F.col(n)) for n in _statistics()],
    )


def _figures() -> list[Column]:
    return [
        F.count("customerid").alias("customers"),
        F.sum(exact("monetary")).alias("monetary"),
        F.sum(exact(TARGET)).alias("revenue"),
        *[c.alias(n) for n, c in _statistics().items()],
    ]


def _quartile_cells(quartiles: DataFrame) -> DataFrame:
    return quartiles.select(
        F.lit("prediction_ltv_description").alias("section"),
        F.col("ltv_cluster").cast("string").alias("key"),
        "stat",
        "value",
    )


def value_summaries(users: DataFrame, quartiles: DataFrame | None = None) -> DataFrame:
    """The six summaries of ``customer_value`` as rows (section, key, stat, value).

    One pass over the customers: in total, by segment and by value cluster are grouping
    sets of the same aggregation. ``quartiles`` (ltv_cluster, stat, value) are found from the
    customers unless they are known.
    """
    grouped = users.groupingSets([[], ["segment"], ["ltv_cluster"]], "segment", "ltv_cluster")
    figures = grouped.agg(F.grouping_id().alias("level"), *_figures())
    segment, level = F.col("segment"), F.col("level")
    # The grouping id has a bit per column that is summed over: 3 is the total.
    cells = (
        F.when(
            level == 3,
            F.array(_cell("rfm_customer_count", F.lit("customerid"), "", F.col("customers"))),
        )
        .when(
            level == 1,
            F.array(
                _cell("rfm_customer_segment_count", segment, "", F.col("customers")),
                _cell("rfm_customer_segment_monetary_value", segment, "", F.col("monetary")),
            ),
        )
        .when(F.col("ltv_cluster").isNotNull(), _cluster_cells())
    )
    if quartiles is None:
        quartiles = _quartiles(users.filter(F.col("ltv_cluster").isNotNull()))
    return figures.select(F.inline(cells)).unionByName(_quartile_cells(quartiles))


def ltv_summaries(ltv: DataFrame) -> DataFrame:
    """The three summaries of the value clusters as rows (section, key, stat, value)."""
    figures = ltv.groupBy("ltv_cluster").agg(*_figures())
    return figures.select(F.inline(_cluster_cells())).unionByName(_quartile_cells(_quartiles(ltv)))


def value_report(
    df: DataFrame, windows: Windows, trim: float = 0.99, k: int = 3, starts: Sequence[str] = STARTS
) -> DataFrame:
    """Scores, future value and all summaries in one call; quartiles come from the histogram that the clusters do."""
    users, found = _valued(df, windows, trim, k, starts, QUARTILES)
    rows = [(cluster, f"{100 * p:.0f}%", value) for cluster, p, value in found]
    return value_summaries(users, df.sparkSession.createDataFrame(rows, "ltv_cluster int, stat string, value double"))


def report_json(summaries: DataFrame) -> DataFrame:
    """The summaries as one JSON text: section to key to value, or to stat to key.

    At most a few dozen rows by now: one per section, segment or cluster, and stat.
    """
    cells = summaries.groupBy("section", "stat").agg(
        F.to_json(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
        ).alias("cell")
    )
    flat = F.col("stat") == ""
    stats = F.when(~flat, F.concat(F.lit('"'), "stat", F.lit('":'), "cell"))
    sections = cells.groupBy("section").agg(
        F.max(F.when(flat, F.col("cell"))).alias("flat"),
        F.concat(
            F.lit("{"), F.array_join(F.array_sort(F.collect_list(stats)), ","), F.lit("}")
        ).alias("nested"),
    )
    pair = F.concat(F.lit('"'), "section", F.lit('":'), F.coalesce("flat", "nested"))
    body = F.array_join(F.array_sort(F.collect_list(pair)), ",")
    return sections.agg(
        F.concat(
            F.lit('{"data":{'),
            body,
            F.lit(f'}},"error":false,"message":"{DONE}"}}'),
        ).alias("report")
    )
