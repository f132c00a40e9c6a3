"""Exact quantiles and what is built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.errors import InvalidDataset
from tallyfold.operators.buckets import ValueBuckets, histogram
from tallyfold.operators.sketches import asked, quantile_of, quantile_sketch, quantile_sketches
from tallyfold.session import materialise, settled

if TYPE_CHECKING:
    from tallyfold.operators.clusters import Clusters


def quantiles(buckets: ValueBuckets, series: object, probabilities: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between neighbours."""
    return quantiles_of_all(buckets, {series: probabilities})[series]


def quantiles_of_all(
    buckets: ValueBuckets, probabilities: dict[object, Sequence[float]]
) -> dict[object, list[float]]:
    """The same for several series, whose buckets are refined together."""
    places = {
        s: [p * (buckets.rows(s) - 1) for p in wanted] for s, wanted in probabilities.items()
    }
    buckets.settle_ranks(
        {s: {r for x in found for r in _neighbours(x)} for s, found in places.items()}
    )
    return {s: [_interpolated(buckets, s, x) for x in found] for s, found in places.items()}


def cluster_quantiles(
    buckets: ValueBuckets, series: object, clusters: Clusters, probabilities: Sequence[float]
) -> list[tuple[int, float, float]]:
    """(label, probability, value) of clusters of a series, whose midpoints are settled; none of an empty cluster."""
    edges = [0, *(buckets.below(series, m)[0] for m in clusters.midpoints), buckets.rows(series)]
    parts = [(r, a, b - a) for r, a, b in zip(clusters.ranks(True), edges, edges[1:]) if b > a]
    places = [(r, start, p, p * (rows - 1)) for r, start, rows in parts for p in probabilities]
    buckets.settle_ranks({series: {start + n for _, start, _, x in places for n in _neighbours(x)}})
    out = []
    for label, start, p, x in places:
        low, high = (buckets.at_rank(series, start + n) for n in _neighbours(x))
        out.append((label, p, min(low + (high - low) * (x - math.floor(x)), high)))
    return out


def _neighbours(place: float) -> tuple[int, int]:
    return math.floor(place), math.ceil(place)


def _interpolated(buckets: ValueBuckets, series: object, place: float) -> float:
    """Equal neighbours give exactly their value, so that ``<`` against it is safe."""
    low, high = (buckets.at_rank(series, r) for r in _neighbours(place))
    return min(low + (high - low) * (place - math.floor(place)), high)


def column_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: str | None = None,
    rank_error: float | None = None,
) -> DataFrame:
    """Quantiles of ``column`` as rows ([by,] probability, value), exact unless a ``rank_error`` is allowed.

    ``by`` may have any number of groups; rows whose group is null are left out. With
    ``rank_error`` they come from sketches in one pass: each is a value of the column, whose
    rank is off by that share of the rows at most, 99 times in 100.
    """
    if rank_error is not None:
        keys = [] if by is None else [by]
        there = df if by is None else df.filter(F.col(by).isNotNull())
        return asked(quantile_sketches(there, column, keys, rank_error), "sketch", probabilities, keys).filter("value IS NOT NULL")
    if by is not None:
        return _quantiles_by(df, column, probabilities, by)
    with ValueBuckets(histogram(df, [column])) as buckets:
        found = quantiles_of_all(buckets, {s: probabilities for s in buckets.series})
    rows = [(float(p), v) for values in found.values() for p, v in zip(probabilities, values)]
    return df.sparkSession.createDataFrame(rows, "probability double, value double")


def _quantiles_by(df: DataFrame, column: str, probabilities: Sequence[float], by: str) -> DataFrame:
    """Quantiles within each group, from running counts over the distinct values.

    Distinct values are sorted by group and value into ranges, so a large group spans
    several tasks. A range adds up its own rows; what lies before it comes from the totals
    of the ranges, one number each.
    """
    value = F.col(column).cast("double")
    there = df.filter(F.col(by).isNotNull() & value.isNotNull() & ~F.isnan(value))
    counted = there.groupBy(F.col(by).alias("g"), value.alias("v")).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("g", "v")
    ranged = materialise(ranged.withColumn("upto", F.sum("n").over(inside)))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("rows")).orderBy("part").collect()
    before, starts = 0, []
    for r in totals:
        starts.append((r["part"], before))
        before += r["rows"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "part int, before long")
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("upto", F.col("upto") + F.col("before"))
    groups = placed.groupBy("g").agg(
        F.min(F.col("upto") - F.col("n")).alias("start"), F.sum("n").alias("rows")
    )
    wanted = F.array(*(F.lit(float(p)) for p in probabilities))
    asked = groups.select("g", "start", F.explode(wanted).alias("probability"), "rows").select(
        "g", "start", "probability", (F.col("probability") * (F.col("rows") - 1)).alias("place")
    )
    asked = asked.groupBy("g", "start").agg(F.collect_list(F.struct("probability", "place")).alias("asked"))
    high = F.col("upto") - F.col("start") - 1
    low = high - F.col("n") + 1
    hit = placed.join(asked, "g").select("g", "v", low.alias("low"), high.alias("high"), F.inline("asked"))
    is_low, is_high = (F.col("low") <= F.floor("place")) & (F.floor("place") <= F.col("high")), (
        F.col("low") <= F.ceil("place")
    ) & (F.ceil("place") <= F.col("high"))
    ends = hit.filter(is_low | is_high).groupBy("g", "probability", "place").agg(
        F.max(F.when(is_low, F.col("v"))).alias("a"), F.max(F.when(is_high, F.col("v"))).alias("b")
    )
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))
    return ends.select(
        F.col("g").alias(by), "probability", F.least(between, F.col("b")).alias("value")
    )


def outlier_trim(
    df: DataFrame, column: str, share: float = 0.99, rank_error: float | None = None
) -> DataFrame:
    """The rows strictly below the quantile, exact unless a ``rank_error`` is allowed; the largest value is always dropped.

    Read twice, for the limit and for the rows, so written to the shared folder first
    unless it is a stored table as it stands.
    """
    base = settled(df)
    if rank_error is not None:
        lowest, sketch = base.agg(F.min(F.col(column).cast("double")), quantile_of(quantile_sketch(column, rank_error), share)).first()
        if sketch is None:
            raise InvalidDataset(f"there are no rows to trim by {column}")
        return base.filter(F.col(column).cast("double") < _something_below(sketch, lowest, share, column))
    with ValueBuckets(histogram(base, [column])) as buckets:
        if not buckets.series:
            raise InvalidDataset(f"there are no rows to trim by {column}")
        limit = trim_limit(buckets, 0, share, column)
    return base.filter(F.col(column).cast("double") < limit)


def trim_limit(buckets: ValueBuckets, series: object, share: float, column: str) -> float:
    return _something_below(quantiles(buckets, series, [share])[0], buckets.low(series), share, column)


def _something_below(limit: float, lowest: float, share: float, column: str) -> float:
    if lowest >= limit:
        raise InvalidDataset(
            f"no row has a {column} below its {share:.0%} quantile of {limit}: nothing is left"
        )
    return limit
