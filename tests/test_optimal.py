"""Proven clusters against a plain search over all cuts."""

from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from tallyfold import cluster_1d
from tallyfold.operators import buckets as buckets_module
from tallyfold.operators import optimal as module
from test_clusters import SAMPLES, column, cost, optimum


def gain(group):
    return Fraction(sum(group)) ** 2 / len(group)


def plain(values, k):
    """The cuts with the largest gain in fractions, the lowest of equal ones: labels of the sorted values."""
    rising = sorted(values)
    steps = [i for i in range(1, len(rising)) if rising[i] != rising[i - 1]]
    k = min(k, len(steps) + 1)
    best = None
    for cuts in combinations(steps, k - 1):
        edges = [0, *cuts, len(rising)]
        found = sum(gain(rising[a:b]) for a, b in zip(edges, edges[1:]))
        if best is None or found > best[0]:
            best = found, edges
    return {v: c for c, (a, b) in enumerate(zip(best[1], best[1][1:])) for v in rising[a:b]}


def labels(spark, values, k):
    rows = cluster_1d(column(spark, values), "value", k, "cluster", method="optimal").collect()
    return {r.value: r.cluster for r in rows}


@pytest.mark.parametrize(
    "values, k",
    [
        ([1, 1, 1, 9, 9], 4),
        ([0, 1, 2, 3, 4, 5], 2),
        ([0, 1, 2, 3, 4], 2),  # two choices are equally good: the lower cut
        ([-3, -1, 0, 0, 0, 1, 3], 3),
        ([7] * 20, 3),
        ([10**9 + i * i for i in range(12)], 4),
        ([0.25, 0.5, 100, 100.25, 1e6, 1e6 + 1, 1e6 + 2], 3),
        ([5, 6], 1),
    ],
)
def test_all_cuts(spark, values, k):
    assert labels(spark, values, k) == plain(values, k)


@pytest.mark.parametrize("seed", range(4))
def test_random_small(spark, seed):
    rng = np.random.default_rng(seed)
    values = [int(v) for v in rng.integers(-9, 10, 14)] + [3] * 9
    assert labels(spark, values, 4) == plain(values, 4)


@pytest.mark.parametrize("name, k", [("lognormal 2", 3), ("lognormal 2.5", 5), ("half zeros", 5), ("whole numbers", 3), ("negative", 3)])
def test_least_error_from_coarse_ranges(spark, name, k, monkeypatch):
    """Ranges so coarse that they are split again and again."""
    monkeypatch.setattr(buckets_module, "STEPS_PER_E", 2)
    monkeypatch.setattr(module, "FIRST_RANGES", 8)
    monkeypatch.setattr(module, "RANGES", 64)
    monkeypatch.setattr(module, "FANOUT", 6)
    values = SAMPLES[name]
    found = cluster_1d(column(spark, values), "value", k, "cluster", method="optimal").toPandas()
    assert cost(found["value"].to_numpy(), found["cluster"].to_numpy()) == pytest.approx(optimum(values, k), rel=1e-9)


def test_ranges_without_cuts_are_dropped(spark, monkeypatch):
    """Of many distinct values few ranges stay in question, and no more than those are split."""
    seen = []
    plain_refine = buckets_module.ValueBuckets.refine

    def refine(self, series, places, fanout):
        seen.append(len(places))
        plain_refine(self, series, places, fanout)

    monkeypatch.setattr(buckets_module.ValueBuckets, "refine", refine)
    df = spark.range(200_000).selectExpr("cast(id as string) customerid", "cast(id * 7919 % 200003 as double) value")
    found = cluster_1d(df, "value", 4, "cluster", method="optimal").groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in found) == pytest.approx([50_000] * 4, rel=0.001)
    assert sum(seen) < 20_000
