"""Connected components of links between numbered vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Scratch


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each vertex hangs its larger neighbours on the smallest vertex it knows."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each vertex hangs itself and its smaller neighbours on the smallest of those."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(vertex, root) for every vertex with a link; root is the smallest vertex it reaches.

    Alternating large and small stars. Rounds grow with the logarithm of the vertices, each
    reads the written links of the one before, and no round holds more links than the first.
    A hub's minimum is combined before the shuffle; its links are split by Spark's skew join.
    ``rows``, if given, is about the number of links.
    """
    links = scratch.write(links.where("a <> b").select("a", "b").distinct(), rows)
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == seen:
            return links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        seen = state
        stars = _small_star(_large_star(links)).where("a <> b").distinct()
        after = scratch.write(stars, state[0])
        scratch.drop(links)
        links = after
