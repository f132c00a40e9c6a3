"""Scores, segments and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.numbers import exact
from tallyfold.session import settled

# A score above the first limit is Mid-Value, above the second High-Value;
# and whether the most recent customers get the lowest recency label.
PROFILES = {
    "all_data": {"limits": (2, 4), "recency_ascending": True},
    "window": {"limits": (2, 5), "recency_ascending": False},
}
# Segments in rising order, with the colour of their points.
SEGMENT_COLOURS = {"Low-Value": "red", "Mid-Value": "blue", "High-Value": "green"}
SEGMENTS = tuple(SEGMENT_COLOURS)


def overall_score() -> Column:
    return F.col("recency_cluster") + F.col("frequency_cluster") + F.col("monetary_cluster")


def segment_of(score: Column, profile: str) -> Column:
    mid, high = PROFILES[profile]["limits"]
    return (
        F.when(score > high, "High-Value").when(score > mid, "Mid-Value").otherwise("Low-Value")
    )


def score(df: DataFrame, profile: str) -> DataFrame:
    """Add the overall score and the segment to three cluster columns."""
    return df.withColumn("overall_score", overall_score()).withColumn(
        "segment", segment_of(F.col("overall_score"), profile)
    )


def of_country(df: DataFrame, country: str = "All") -> DataFrame:
    return df if country == "All" else df.filter(F.col("country") == country)


def segment_counts(segments: DataFrame, country: str = "All") -> DataFrame:
    """Customers per segment, in rising order, 0 where there is none.

    Three conditional counts in one pass, turned into three rows.
    """
    counted = of_country(segments, country).agg(
        *[F.count_if(F.col("segment") == s).alias(s) for s in SEGMENTS]
    )
    rows = [
        F.struct(F.lit(s).alias("segment"), F.col(f"`{s}`").alias("customers")) for s in SEGMENTS
    ]
    return counted.select(F.inline(F.array(*rows)))


def scatter(
    segments: DataFrame, x: str, y: str, country: str = "All", grid: int | None = None, per_cell: int = 1
) -> DataFrame:
    """Points of two metrics with the segment and its colour: one for each row, or with ``grid`` fewer.

    With ``grid`` the plane between the extremes is cut into ``grid`` by ``grid`` cells, and each
    segment has ``per_cell`` points in a cell at most: rows are dealt to as many lots by a digest of
    the customer, and a lot's point is the one of its least digest. So the same rows give the
    same points however they lie, every segment and every part of the plane that has points
    keeps some, and their number does not grow with the rows.
    """
    colours = F.create_map(*[F.lit(part) for pair in SEGMENT_COLOURS.items() for part in pair])
    points = of_country(segments, country).select(
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
        "segment",
        colours[F.col("segment")].alias("colour"),
        *([] if grid is None else [F.md5(F.col("customerid").cast("binary")).alias("digest")]),
    )
    return points if grid is None else _thinned(points, grid, per_cell)


def _thinned(points: DataFrame, grid: int, per_cell: int) -> DataFrame:
    base = settled(points)

    def cell(name: str) -> Column:
        low, high = base.agg(F.min(name)).scalar(), base.agg(F.max(name)).scalar()
        share = (F.col(name) - low) / F.nullif(high - low, F.lit(0.0))
        return F.coalesce(F.least(F.floor(share * grid), F.lit(grid - 1)), F.lit(0)).alias(f"cell_{name}")

    lot = (F.conv(F.substr("digest", F.lit(1), F.lit(7)), 16, 10).cast("long") % per_cell).alias("lot")
    least = F.min(F.struct("digest", "x", "y")).alias("point")
    thin = base.groupBy("segment", "colour", cell("x"), cell("y"), lot).agg(least)
    return thin.select("point.x", "point.y", "segment", "colour")


def score_profile(segments: DataFrame) -> DataFrame:
    """Mean recency, frequency and monetary value per overall score."""
    return segments.groupBy("overall_score").agg(
        F.avg("recency").alias("mean_recency"),
        F.avg("frequency").alias("mean_frequency"),
        F.avg(exact("monetary")).cast("double").alias("mean_monetary"),
    )


def segment_value(segments: DataFrame) -> DataFrame:
    """Money per segment, for the segments that occur."""
    total = F.sum(exact("monetary")).cast("double")
    return segments.groupBy("segment").agg(total.alias("monetary"))


def segment_sizes(segments: DataFrame) -> DataFrame:
    """Customers per segment, for the segments that occur."""
    return segments.groupBy("segment").agg(F.count("customerid").alias("customers"))


def segment_onehot(df: DataFrame) -> DataFrame:
    """A 0/1 column per segment in place of its name."""
    flags = {
        "segment_" + s.lower().replace("-", "_"): (F.col("segment") == s).cast("int")
        for s in SEGMENTS
    }
    return df.withColumns(flags).drop("segment")
