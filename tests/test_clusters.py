import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold import InvalidDataset, cluster_1d, column_quantiles, order_cluster, outlier_trim
from tallyfold.operators import buckets as module
from tallyfold.operators.buckets import ValueBuckets, histogram
from tallyfold.operators.clusters import STARTS, fit_lloyd


def column(spark, values):
    rows = [(str(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "customerid string, value double")


def samples():
    rng = np.random.default_rng(5)
    return {
        "lognormal 2": rng.lognormal(5, 2, 2000),
        "lognormal 2.5": rng.lognormal(5, 2.5, 2000),
        "pareto 1.2": rng.pareto(1.2, 2000) * 100,
        "pareto 2": rng.pareto(2, 2000) * 100,
        "half zeros": np.where(rng.random(2000) < 0.5, 0, rng.lognormal(5, 1.5, 2000)),
        "whole numbers": rng.integers(0, 40, 2000).astype(float),
        "negative": rng.normal(0, 100, 2000),
    }


SAMPLES = {name: np.round(values, 4) for name, values in samples().items()}


def cost(values, labels):
    return sum(((values[labels == c] - values[labels == c].mean()) ** 2).sum() for c in set(labels))


def optimum(values, k):
    """Least squared error of k intervals, by dynamic programming over distinct values."""
    v, w = np.unique(values, return_counts=True)
    cw, cs, cq = (np.concatenate([[0], np.cumsum(x)]) for x in (w, w * v, w * v * v))
    best = np.array([cq[j] - cs[j] ** 2 / cw[j] if j else 0 for j in range(len(v) + 1)])
    for _ in range(k - 1):
        after = np.full(len(v) + 1, np.inf)
        after[0] = 0
        for j in range(1, len(v) + 1):
            i = np.arange(j)
            n, s, q = cw[j] - cw[i], cs[j] - cs[i], cq[j] - cq[i]
            after[j] = (best[i] + q - s * s / n).min()
        best = after
    return best[-1]


def lloyd(values, k, steps=60):
    """The plain iteration over all values, from quantiles."""
    centres = np.quantile(values, [(2 * i + 1) / (2 * k) for i in range(k)])
    for _ in range(steps):
        labels = np.searchsorted((centres[1:] + centres[:-1]) / 2, values, side="left")
        moved = np.array([values[labels == c].mean() if (labels == c).any() else centres[c] for c in range(k)])
        if np.allclose(moved, centres, rtol=1e-13, atol=0):
            break
        centres = moved
    return centres


def fitted(spark, values, k, starts):
    with ValueBuckets(histogram(column(spark, values), ["value"])) as buckets:
        return fit_lloyd(buckets, {0: k}, starts)[0]


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("steps, fanout", [(4096, 512), (1, 3)])
def test_same_centres_as_the_plain_iteration(spark, name, steps, fanout, monkeypatch):
    monkeypatch.setattr(module, "STEPS_PER_E", steps)
    monkeypatch.setattr(module, "FANOUT", fanout)
    found = fitted(spark, SAMPLES[name], 4, ("quantile",))
    assert found.centres == pytest.approx(lloyd(SAMPLES[name], 4), rel=1e-9)


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("k", [3, 4])
def test_best_start_is_close_to_the_optimum(spark, name, k):
    values = SAMPLES[name]
    df = cluster_1d(column(spark, values), "value", k, "cluster").toPandas()
    assert cost(df["value"].to_numpy(), df["cluster"].to_numpy()) <= 1.15 * optimum(values, k) + 1e-6


@pytest.mark.parametrize("start", STARTS)
def test_labels_rise_with_the_value(spark, start):
    df = cluster_1d(column(spark, SAMPLES["pareto 2"]), "value", 4, "cluster", starts=(start,))
    spans = df.groupBy("cluster").agg(F.min("value"), F.max("value")).orderBy("cluster").collect()
    assert [r[0] for r in spans] == [0, 1, 2, 3]
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    falling = cluster_1d(column(spark, SAMPLES["pareto 2"]), "value", 4, "cluster", False, starts=(start,))
    assert {(r.customerid, 3 - r.cluster) for r in falling.select("customerid", "cluster").collect()} == {
        (r.customerid, r.cluster) for r in df.select("customerid", "cluster").collect()
    }


def test_spark_ml_method(spark):
    values = SAMPLES["whole numbers"]
    df = cluster_1d(column(spark, values), "value", 4, "cluster", method="ml", seeds=(0, 1)).toPandas()
    assert cost(df["value"].to_numpy(), df["cluster"].to_numpy()) <= 1.2 * optimum(values, 4)


def test_fewer_values_than_clusters_are_numbered_densely(spark):
    df = cluster_1d(column(spark, [1, 1, 1, 9, 9]), "value", 4, "cluster")
    assert {(r.value, r.cluster) for r in df.collect()} == {(1.0, 0), (9.0, 1)}
    falling = cluster_1d(column(spark, [1, 1, 1, 9, 9]), "value", 4, "cluster", ascending=False)
    assert {(r.value, r.cluster) for r in falling.collect()} == {(1.0, 1), (9.0, 0)}


@pytest.mark.parametrize("values", [[1, 2, 3], []])
@pytest.mark.parametrize("method", ["lloyd", "optimal", "ml"])
def test_too_few_rows(spark, values, method):
    with pytest.raises(InvalidDataset, match="too few"):
        cluster_1d(column(spark, values), "value", 4, "cluster", method=method)


@pytest.mark.parametrize("name", SAMPLES)
def test_exact_quantiles(spark, name, monkeypatch):
    monkeypatch.setattr(module, "STEPS_PER_E", 2)
    monkeypatch.setattr(module, "FANOUT", 8)
    shares = (0, 0.01, 0.25, 0.5, 0.75, 0.99, 1)
    found = column_quantiles(column(spark, SAMPLES[name]), "value", shares).collect()
    assert [r.value for r in found] == pytest.approx(list(np.quantile(SAMPLES[name], shares)), rel=1e-12)


def test_quantiles_by_group(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(100)], "g int, value double")
    found = {(r.g, r.probability): r.value for r in column_quantiles(df, "value", (0.5, 0.9), "g").collect()}
    for g in range(3):
        values = [i for i in range(100) if i % 3 == g]
        assert found[g, 0.5] == np.quantile(values, 0.5)
        assert found[g, 0.9] == pytest.approx(np.quantile(values, 0.9))


def test_any_number_of_groups(spark):
    """Quantiles of many small groups and of one that spans several ranges."""
    rows = [(i % 700, float(i * i % 997)) for i in range(5000)] + [(9999, i / 7) for i in range(20000)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g int, value double")
    found = {(r.g, r.probability): r.value for r in column_quantiles(df, "value", (0.0, 0.3, 1.0), by="g").collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    del groups[None]
    assert set(found) == {(g, p) for g in groups for p in (0.0, 0.3, 1.0)}
    for (g, p), v in found.items():
        assert v == pytest.approx(np.quantile(groups[g], p), rel=1e-12, abs=1e-12)


def test_a_skewed_column_takes_all_the_steps_it_needs(spark):
    """More than the 60 that are foreseen at a time, to the same end as the plain iteration."""
    h = np.arange(1, 6001) * 2654435761 % 1000003
    values = (10**12 // (1 + h)).astype(float)
    k, steps = 12, 0
    centres = np.quantile(values, [(2 * i + 1) / (2 * k) for i in range(k)])
    while True:
        labels = np.searchsorted((centres[1:] + centres[:-1]) / 2, values, side="left")
        moved = np.array([values[labels == c].sum() / (labels == c).sum() for c in range(k)])
        steps += 1
        if (moved == centres).all():
            break
        centres = moved
    assert steps > 60
    with ValueBuckets(histogram(column(spark, values), ["value"])) as buckets:
        found = fit_lloyd(buckets, {0: k}, ("quantile",))[0]
    assert found.rows == tuple(np.bincount(labels))


def test_no_decimal_is_lost(spark):
    tiny = spark.range(1000).select((F.col("id") * 1e-7).alias("value"))
    (median,) = column_quantiles(tiny, "value", (0.5,)).collect()
    assert median.value == pytest.approx(4.995e-05, rel=1e-12)
    assert cluster_1d(tiny, "value", 4, "c").select("c").distinct().count() == 4
    near = spark.createDataFrame([(0.0,)] + [(99.99996,)] * 99, "value double")
    assert outlier_trim(near, "value").count() == 1
    huge = spark.createDataFrame([(1e300,), (1.0,)], "value double")
    with pytest.raises(Exception, match="38 digits"):
        cluster_1d(huge, "value", 1, "c").collect()


def test_trim_drops_the_largest(spark):
    kept = outlier_trim(column(spark, range(101)), "value")
    assert kept.agg(F.max("value"), F.count("*")).collect()[0][:] == (98.0, 99)


def test_trim_of_equal_values_leaves_nothing(spark):
    with pytest.raises(InvalidDataset, match="nothing is left"):
        outlier_trim(column(spark, [7.1] * 30), "value")


def test_order_cluster(spark):
    df = spark.createDataFrame([(0, 5.0, "a"), (1, 1.0, "b"), (1, 3.0, "c"), (2, 9.0, "d")], "label int, x double, s string")
    rising = order_cluster(df, "label", "x")
    assert rising.columns == ["x", "s", "label"]
    assert {r.s: r.label for r in rising.collect()} == {"b": 0, "c": 0, "a": 1, "d": 2}
    assert {r.s: r.label for r in order_cluster(df, "label", "x", False).collect()} == {"d": 0, "a": 1, "b": 2, "c": 2}


def test_known_centres(spark):
    """Regression values over the whole history of the sf0.01 tables."""
    from tallyfold_checks.views import PREDICTED, retail
    from tallyfold import rfm_metrics

    df = rfm_metrics(retail(spark, "/root/testdata/sf0.01", *PREDICTED))
    names = ["recency", "frequency", "monetary"]
    with ValueBuckets(histogram(df, names)) as buckets:
        found = fit_lloyd(buckets, {0: 4, 1: 4, 2: 4}, ("quantile",))
    assert found[0].centres == (72.57472826086956, 260.30434782608694, 533.4291666666667, 996.9375)
    assert found[1].centres == (21.839285714285715, 34.29397590361446, 45.59146341463415, 62.252918287937746)
    assert found[2].centres == (494786.9356435643, 842267.6552293579, 1164094.6851612905, 1591386.6085561498)


def test_wide_range_needs_few_jobs(spark, monkeypatch):
    """A hundred thousand heavy-tailed values: the number of splits stays small."""
    calls = []
    split = ValueBuckets._split
    monkeypatch.setattr(ValueBuckets, "_split", lambda self, t: (calls.append(len(t)), split(self, t))[1])
    df = spark.range(0, 100000, 1, 4).selectExpr("cast(exp(randn(3) * 2) * 100 as decimal(24,4)) as value")
    with ValueBuckets(histogram(df, ["value"])) as buckets:
        fit_lloyd(buckets, {0: 4})
    assert len(calls) <= 20
    assert max(calls) <= module.SPLITS_PER_JOB


def test_any_number_of_labels_is_renumbered(spark):
    from pyspark.sql import functions as F
    from tallyfold import order_cluster

    n = 120_000
    df = spark.range(n).select(F.col("id").alias("label"), ((F.col("id") * 7919) % n).alias("x"))
    ranked = order_cluster(df, "label", "x", ascending=False)
    assert ranked.filter(F.col("label") != n - 1 - F.col("x")).count() == 0 and ranked.count() == n
    tied = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.0), (None, 9.0)], "label string, x double")
    assert sorted((r.x, r.label) for r in order_cluster(tied, "label", "x").collect()) == [(0.0, 0), (1.0, 1), (1.0, 2)]
