"""One-dimensional k-means, deterministic, over columns of any size; its optimum on request.

Spark counts the distinct values (``buckets.histogram``) and sums ranges of them;
the Lloyd iteration itself only moves k centres per column. Labels are then a chain
of comparisons with the k-1 midpoints: a projection, without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.errors import InvalidDataset
from tallyfold.operators.buckets import Histogram, ValueBuckets, histogram
from tallyfold.operators.optimal import best_cuts
from tallyfold.operators.quantiles import quantiles_of_all
from tallyfold.session import materialise, settled

STARTS = ("quantile", "range", "farthest")
# Steps played through to foresee which ranges to split; the iteration itself has no limit.
FORESIGHT = 60
# Seeds and steps of Spark ML's k-means.
SEEDS = (0, 1, 2)
ML_STEPS = 300

# A series and the start it is clustered from.
Run = tuple[object, str]


@dataclass(frozen=True)
class Clusters:
    """Sorted centres, how many values each one holds, and where they part if that is not half way."""

    centres: tuple[float, ...]
    rows: tuple[int, ...]
    cuts: tuple[float, ...] | None = None

    @property
    def midpoints(self) -> list[float]:
        return _midpoints(self.centres) if self.cuts is None else list(self.cuts)

    def ranks(self, ascending: bool = True) -> list[int]:
        """New label of each cluster: its place among those that hold anything."""
        places, place = [], -1
        for n in self.rows:
            place += n > 0
            places.append(max(place, 0))
        return places if ascending else [place - p for p in places]


def _midpoints(centres: Sequence[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


def _shares(below, buckets: ValueBuckets, series: object, centres: Sequence[float]) -> list[tuple]:
    """Rows and sum of each cluster; a value on a midpoint belongs to the lower one.

    ``below`` is the exact count and sum up to a threshold, or an estimate of them.
    """
    edges = [(0, 0), *(below(series, m) for m in _midpoints(centres))]
    edges.append((buckets.rows(series), buckets.total(series)))
    return [(n - m, t - s) for (m, s), (n, t) in zip(edges, edges[1:])]


def _moved(centres: Sequence[float], shares: Sequence[tuple], units: int) -> tuple[float, ...]:
    """Means of the clusters; an empty one stays where it is."""
    return tuple(t / units / n if n > 0 else c for c, (n, t) in zip(centres, shares))


def _range_start(buckets: ValueBuckets, series: object, k: int) -> tuple[float, ...]:
    low, high = buckets.low(series), buckets.high(series)
    return tuple(low + (high - low) * ((2 * i + 1) / (2 * k)) for i in range(k))


def _farthest_start(buckets: ValueBuckets, series: object, k: int) -> tuple[float, ...]:
    """The mean, then k-1 times the value farthest from all centres so far."""
    centres = [buckets.total(series) / buckets.units(series) / buckets.rows(series)]
    while len(centres) < k:
        gaps = _midpoints(centres)
        buckets.settle({series: gaps})
        candidates = {buckets.low(series), buckets.high(series)}
        candidates.update(v for m in gaps for v in buckets.around(series, m) if v is not None)
        centres.append(max(sorted(candidates), key=lambda v: min(abs(v - c) for c in centres)))
        centres.sort()
    return tuple(centres)


def _start_centres(
    buckets: ValueBuckets, ks: dict[object, int], starts: Sequence[str]
) -> dict[Run, tuple[float, ...]]:
    """First centres per series and start, in the order of ``starts``."""
    unknown = set(starts) - set(STARTS)
    if unknown or not starts:
        raise ValueError(f"starts must be some of {STARTS}")
    found: dict[Run, tuple[float, ...]] = {}
    if "quantile" in starts:
        shares = {s: [(2 * i + 1) / (2 * k) for i in range(k)] for s, k in ks.items()}
        by_quantile = quantiles_of_all(buckets, shares)
    for s, k in ks.items():
        for start in starts:
            if start == "quantile":
                found[s, start] = tuple(by_quantile[s])
            elif start == "range":
                found[s, start] = _range_start(buckets, s, k)
            else:
                found[s, start] = _farthest_start(buckets, s, k)
    return found


def fit_lloyd(
    buckets: ValueBuckets,
    ks: dict[object, int],
    starts: Sequence[str] = STARTS,
) -> dict[object, Clusters]:
    """Cluster several series at once: a step of all of them shares its Spark jobs.

    Each run goes on until no centre moves, or, should rounding make it go round in
    circles, until it comes back to centres it has had. Of several starts the tightest
    result wins, the earlier one on a tie.
    """
    for s, k in ks.items():
        if buckets.rows(s) < k:
            raise InvalidDataset(f"{buckets.rows(s)} rows are too few for {k} clusters")
    centres = _start_centres(buckets, ks, starts)
    moving = set(centres)
    had = {run: {start} for run, start in centres.items()}
    while moving:
        runs = {run: centres[run] for run in moving}
        buckets.settle(_thresholds(runs), lambda: _foreseen(buckets, runs))
        for run in sorted(moving):
            shares = _shares(buckets.below, buckets, run[0], centres[run])
            centres[run] = _moved(centres[run], shares, buckets.units(run[0]))
            if centres[run] in had[run]:
                moving.discard(run)
            had[run].add(centres[run])
    buckets.settle(_thresholds(centres))
    best: dict[object, tuple[Fraction, Clusters]] = {}
    for (s, _), found in centres.items():
        shares = _shares(buckets.below, buckets, s, found)
        # The squared error is the sum of all squares, which no choice of clusters
        # changes, less this: compared as fractions, no rounding decides a tie.
        tightness = sum((Fraction(t * t, n) for n, t in shares if n), Fraction(0))
        if s not in best or tightness > best[s][0]:
            best[s] = tightness, Clusters(found, tuple(n for n, _ in shares))
    return {s: clusters for s, (_, clusters) in best.items()}


def _thresholds(runs: Mapping[Run, Sequence[float]]) -> dict[object, list[float]]:
    points: dict[object, list[float]] = {}
    for (s, _), centres in runs.items():
        points.setdefault(s, []).extend(_midpoints(centres))
    return points


def _foreseen(
    buckets: ValueBuckets, runs: Mapping[Run, Sequence[float]]
) -> dict[object, list[float]]:
    """Where the midpoints will go, going by estimates: the coming steps, played through."""
    points: dict[object, list[float]] = {}
    for (s, _), centres in runs.items():
        for _ in range(FORESIGHT):
            points.setdefault(s, []).extend(_midpoints(centres))
            moved = _moved(centres, _shares(buckets.estimate, buckets, s, centres), buckets.units(s))
            if moved == centres:
                break
            centres = moved
    return points


def fit_optimal(buckets: ValueBuckets, ks: Mapping[object, int]) -> dict[object, Clusters]:
    """The clusters of least squared error of several series.

    Of equally good ones those with the lowest cuts; as many as there are distinct values, if
    that is fewer than asked for.
    """
    found: dict[object, Clusters] = {}
    for s, k in ks.items():
        if buckets.rows(s) < k:
            raise InvalidDataset(f"{buckets.rows(s)} rows are too few for {k} clusters")
        units = buckets.units(s)
        cuts = tuple((low + high) / (2 * units) for low, high in best_cuts(buckets, s, k))
        edges = [(0, 0), *(buckets.below(s, c) for c in cuts), (buckets.rows(s), buckets.total(s))]
        shares = [(n - m, t - u) for (m, u), (n, t) in zip(edges, edges[1:])]
        found[s] = Clusters(tuple(t / units / n for n, t in shares), tuple(n for n, _ in shares), cuts)
    return found


def fit_ml(hist: Histogram, k: int, seeds: Sequence[int] = SEEDS) -> Clusters:
    """Centres from Spark ML's k-means on the weighted histogram, best of the seeds."""
    number = F.col("value").cast("double") / F.lit(float(10 ** hist.scales[0]))
    points = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        hist.counted.select(number.alias("x"), F.col("rows").cast("double"))
    ).persist()
    try:
        count = points.agg(F.sum("rows")).head()[0] or 0
        if count < k:
            raise InvalidDataset(f"{int(count)} rows are too few for {k} clusters")
        models = [KMeans(k=k, seed=s, weightCol="rows", maxIter=ML_STEPS).fit(points) for s in seeds]
    finally:
        points.unpersist()
    model = min(models, key=lambda m: m.summary.trainingCost)
    centres = sorted(float(c[0]) for c in model.clusterCenters())
    return Clusters(tuple(centres), (1,) * len(centres))


def assign(
    df: DataFrame, column: str, out: str, clusters: Clusters, ascending: bool = True
) -> DataFrame:
    """Add the label of ``column``'s cluster, numbered by the order of the centres."""
    value = F.col(column).cast("double")
    *inner, last = clusters.ranks(ascending)
    label = F.lit(last)
    for rank, midpoint in reversed(list(zip(inner, clusters.midpoints))):
        label = F.when(value <= midpoint, rank).otherwise(label)
    return df.withColumn(out, F.when(value.isNotNull() & ~F.isnan(value), label).cast("int"))


def cluster_1d(
    df: DataFrame,
    column: str,
    k: int,
    out: str,
    ascending: bool = True,
    method: str = "lloyd",
    starts: Sequence[str] = STARTS,
    seeds: Sequence[int] = SEEDS,
) -> DataFrame:
    """Add cluster labels of one column.

    ``method`` "lloyd" takes the best of ``starts``, "optimal" the least squared error there is
    (``operators.optimal``), "ml" the best of ``seeds`` by Spark ML.

    The table is read twice, once for the centres and once for the labels, so it is
    written to the shared folder first unless it is a stored table as it stands.
    """
    if method not in ("lloyd", "optimal", "ml"):
        raise ValueError("method must be lloyd, optimal or ml")
    base = settled(df)
    hist = histogram(base, [column])
    if method == "ml":
        found = fit_ml(hist, k, seeds)
    else:
        with ValueBuckets(hist) as buckets:
            if not buckets.series:
                raise InvalidDataset(f"0 rows are too few for {k} clusters")
            found = (fit_optimal(buckets, {0: k}) if method == "optimal" else fit_lloyd(buckets, {0: k}, starts))[0]
    return assign(base, column, out, found, ascending)


def order_cluster(
    df: DataFrame, cluster_column: str, target_column: str, ascending: bool = True
) -> DataFrame:
    """Renumber labels by the mean of the target; the label column moves to the end.

    There may be any number of labels: their means are sorted into ranges, and a range's ranks go
    on where those before it end. The ranks are written to the shared folder, so that Spark knows their size before it
    plans the join: few of them are broadcast and the rows of ``df`` stay where they are,
    be one label as frequent as it may.
    """
    means = materialise(df.groupBy(cluster_column).agg(F.avg(target_column).alias("_mean")))
    order = [F.col("_mean").asc() if ascending else F.col("_mean").desc(), F.col(cluster_column).asc()]
    ranged = means.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).cast("int").alias("_part")
    before, starts = 0, []
    for r in placed.groupBy(part).count().orderBy("_part").collect():  # a row for each range
        starts.append((r["_part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _before long")
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    ranks = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
        cluster_column, (F.col("_before") + inside).cast("int").alias("_rank")
    )
    return (
        df.join(materialise(ranks), cluster_column)
        .drop(cluster_column)
        .withColumnRenamed("_rank", cluster_column)
    )
