"""Customers segmented by recency, frequency and monetary value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.errors import InvalidDataset
from tallyfold.operators.buckets import ValueBuckets, histogram
from tallyfold.operators.clusters import STARTS, Clusters, assign, fit_lloyd
from tallyfold.operators.rfm import customer_country_totals, customer_totals, with_recency
from tallyfold.operators.scoring import PROFILES, score

METRICS = ("recency", "frequency", "monetary")
CLUSTERS = 4


def segment(
    df: DataFrame,
    profile: str = "all_data",
    starts: Sequence[str] = STARTS,
) -> DataFrame:
    """R, F and M with their clusters, the overall score and the segment.

    Profile "all_data" gives one row per customer and country, "window" one per
    customer. The fact table is read once; its totals are written to the shared
    folder, and clustering and labelling work on those.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
    if profile == "all_data":
        keys, totals = ["customerid", "country"], customer_country_totals(df)
    else:
        keys, totals = ["customerid"], customer_totals(df)
    base = with_recency(totals)
    with ValueBuckets(histogram(base, METRICS)) as buckets:
        if not buckets.series:
            raise InvalidDataset("there are no customers to segment")
        found = fit_lloyd(buckets, {i: CLUSTERS for i in range(len(METRICS))}, starts)
    return labelled(base, found, profile).select(*keys, *segment_columns())


def segment_columns() -> list:
    columns: list = []
    for m in METRICS:
        columns += [F.col(m).cast("double") if m == "monetary" else m, f"{m}_cluster"]
    return [*columns, "overall_score", "segment"]


def labelled(base: DataFrame, found: dict[object, Clusters], profile: str) -> DataFrame:
    """Cluster labels, score and segment beside the metrics: a projection."""
    freshest_last = PROFILES[profile]["recency_ascending"]
    for i, m in enumerate(METRICS):
        base = assign(base, m, f"{m}_cluster", found[i], freshest_last if m == "recency" else True)
    return score(base, profile)
