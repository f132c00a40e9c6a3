"""Exact counts, sums and order statistics of number columns of any size.

Spark reduces a table to a histogram (series, value, rows) and sums ranges of it.
The driver holds only range totals. Where a question falls inside a range, Spark
splits that range into a fixed number of finer ones and sums them again, until the
answer is exact. So no task and no driver ever holds all values of a column, which
the built-in ``percentile`` needs, and a value shared by a third of all rows is one
row of the histogram.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

# The first ranges are steps of a logarithmic scale, this many per unit of ln(1 + |value|):
# some 57,000 for amounts up to a million, 380,000 for the whole range of the type.
STEPS_PER_E = 4096
# Finer ranges per split of one range.
FANOUT = 512
# Ranges split by one job: bounds what is broadcast, and the rows that reach the driver.
SPLITS_PER_JOB = 512
# Digits of the whole units that a value, and the sum of all values, is counted in.
DIGITS = 31
UNIT = "decimal(38,0)"

Thresholds = Mapping[object, Iterable[float]]


@dataclass(frozen=True)
class Bucket:
    """Totals of the values from ``low`` to ``high``, in whole units of their series.

    ``slot`` is the step of the logarithmic scale that they lie in.
    """

    slot: int
    low: int
    high: int
    rows: int
    total: int


@dataclass(frozen=True)
class Histogram:
    """Rows per distinct value: (series, value, rows, slot).

    A value is a whole number of units, ``10 ** -scales[series]`` each.
    """

    counted: DataFrame
    scales: tuple[int, ...]


def decimals(df: DataFrame, column: str) -> int:
    """Decimals that hold every value of ``column``.

    A decimal type says so itself. A binary number has the digits that tell it from its
    neighbours; there is room for them unless the largest value is 10**14 times as large.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, DecimalType):
        return kind.scale
    if isinstance(kind, IntegralType):
        return 0
    number = F.nanvl(F.abs(F.col(column).cast("double")), F.lit(None).cast("double"))
    found = df.agg(F.max(number).alias("largest"), F.count("*").alias("rows")).head()
    if found.largest is None or found.largest == float("inf"):
        return 0
    return max(0, DIGITS - len(str(int(found.largest))) - len(str(found.rows)))


def whole_units(df: DataFrame, column: str, scale: int) -> Column:
    """``column`` in units of ``10 ** -scale``; null for null and NaN, an error for what has too many digits."""
    value = F.col(column)
    number = value.try_cast(f"decimal(38,{scale})")
    units = (number * F.lit(Decimal(10**scale)).cast(f"decimal({scale + 1},0)")).cast(UNIT)
    there = value.isNotNull() & ~F.isnan(value.cast("double"))
    message = f"column {column} holds a number that does not fit 38 digits"
    return F.when(there, F.coalesce(units, F.raise_error(F.lit(message)).cast(UNIT)))


def histogram(df: DataFrame, columns: Sequence[str]) -> Histogram:
    """Rows per distinct value of each column, all columns in one shuffle."""
    scales = tuple(decimals(df, c) for c in columns)
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("series"),
                whole_units(df, c, scale).alias("value"),
                F.col(c).cast("double").alias("number"),
            )
            for i, (c, scale) in enumerate(zip(columns, scales))
        ]
    )
    scale = F.signum("number") * F.log1p(F.abs("number"))
    counted = (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("series", "value")
        .agg(F.count("*").alias("rows"), F.min("number").alias("number"))
        .withColumn("slot", F.floor(scale * STEPS_PER_E).cast("int"))
        .drop("number")
    )
    return Histogram(counted, scales)


class ValueBuckets:
    """Range totals of a histogram, refined on demand. Use as a context manager."""

    def __init__(self, hist: Histogram):
        self._hist = hist.counted
        self._units = {s: 10**scale for s, scale in enumerate(hist.scales)}
        self._buckets: dict[object, list[Bucket]] = {}
        self._rows: dict[object, list[int]] = {}
        self._totals: dict[object, list[int]] = {}

    def __enter__(self) -> ValueBuckets:
        self._hist = self._hist.persist(StorageLevel.MEMORY_AND_DISK)
        found: dict[object, list[Bucket]] = {}
        for row in self._hist.groupBy("series", "slot").agg(*_totals()).collect():
            found.setdefault(row["series"], []).append(_bucket(row, row["slot"]))
        for s, buckets in found.items():
            self._store(s, sorted(buckets, key=lambda b: b.low))
        return self

    def __exit__(self, *exc: object) -> None:
        self._hist.unpersist()

    @property
    def series(self) -> list:
        return sorted(self._buckets)

    def units(self, series: object) -> int:
        """How many units make one."""
        return self._units[series]

    def rows(self, series: object) -> int:
        return self._rows[series][-1] if self._rows.get(series) else 0

    def low(self, series: object) -> float:
        return self._buckets[series][0].low / self._units[series]

    def high(self, series: object) -> float:
        return self._buckets[series][-1].high / self._units[series]

    def total(self, series: object) -> int:
        return self._totals[series][-1]

    def ranges(self, series: object) -> Sequence[Bucket]:
        """The ranges as they are, rising."""
        return self._buckets[series]

    def refine(self, series: object, places: Sequence[int], fanout: int = FANOUT) -> None:
        """Split the ranges at these places, each into up to ``fanout`` finer ones."""
        step = max(1, min(SPLITS_PER_JOB, SPLITS_PER_JOB * FANOUT // fanout))
        rising = sorted(places)
        for end in range(len(rising), 0, -step):  # from above, so that the places below stay
            self._split([(series, i) for i in rising[max(0, end - step) : end]], fanout)

    def settle(
        self,
        thresholds: Thresholds,
        ahead: Callable[[], Thresholds] = dict,
    ) -> None:
        """Split until no bucket has values on both sides of any threshold.

        ``ahead`` foresees thresholds that will be asked for next; the buckets around
        those are split by the same jobs.
        """
        while wanted := self._straddled(thresholds):
            self._split(list(dict.fromkeys(wanted + self._straddled(ahead()))))

    def settle_ranks(self, ranks: Mapping[object, Iterable[int]]) -> None:
        """Split until the value at each rank (from 0) is known."""
        while wanted := [
            (s, i) for s, places in ranks.items() for r in places
            if (i := self._undecided(s, r)) is not None
        ]:
            self._split(list(dict.fromkeys(wanted)))

    def estimate(self, series: object, threshold: float) -> tuple[float, float]:
        """About what ``below`` will say, from the buckets as they are."""
        rows, total = self.below(series, threshold)
        i = self._straddling(series, threshold)
        if i is None:
            return rows, total
        b, units = self._buckets[series][i], self._units[series]
        share = (threshold * units - b.low) / (b.high - b.low)
        return rows + b.rows * share, total + b.rows * share * (b.low + threshold * units) / 2

    def below(self, series: object, threshold: float) -> tuple[int, int]:
        """Rows and sum (in units) of the values up to a settled threshold."""
        count = self._up_to(series, threshold)
        return (self._rows[series][count - 1], self._totals[series][count - 1]) if count else (0, 0)

    def at_rank(self, series: object, rank: int) -> float:
        bucket, place = self._locate(series, rank)
        return (bucket.low if place == 0 else bucket.high) / self._units[series]

    def around(self, series: object, threshold: float) -> tuple[float | None, float | None]:
        """The values next to a settled threshold, from below (or on it) and from above."""
        count = self._up_to(series, threshold)
        buckets, units = self._buckets[series], self._units[series]
        under = buckets[count - 1].high / units if count else None
        over = buckets[count].low / units if count < len(buckets) else None
        return under, over

    def cut(self, series: object, threshold: float) -> None:
        """Forget the values above a settled threshold."""
        self._store(series, self._buckets[series][: self._up_to(series, threshold)])

    def _store(self, series: object, buckets: list[Bucket]) -> None:
        self._buckets[series] = buckets
        self._rows[series] = list(accumulate(b.rows for b in buckets))
        self._totals[series] = list(accumulate(b.total for b in buckets))

    def _up_to(self, series: object, threshold: float) -> int:
        units = self._units[series]
        return bisect_right(self._buckets[series], threshold, key=lambda b: b.high / units)

    def _straddling(self, series: object, threshold: float) -> int | None:
        place = self._up_to(series, threshold)
        buckets, units = self._buckets[series], self._units[series]
        return place if place < len(buckets) and buckets[place].low / units <= threshold else None

    def _locate(self, series: object, rank: int) -> tuple[Bucket, int]:
        i = bisect_right(self._rows[series], rank)
        bucket = self._buckets[series][i]
        return bucket, rank - (self._rows[series][i] - bucket.rows)

    def _undecided(self, series: object, rank: int) -> int | None:
        bucket, place = self._locate(series, rank)
        if bucket.low == bucket.high or place in (0, bucket.rows - 1):
            return None
        return bisect_right(self._rows[series], rank)

    def _straddled(self, thresholds: Thresholds) -> list[tuple[object, int]]:
        return [
            (s, i) for s, points in thresholds.items() for t in points
            if (i := self._straddling(s, t)) is not None
        ]

    def _split(self, targets: Sequence[tuple[object, int]], fanout: int | None = None) -> None:
        """Replace buckets by finer ones: one job over the histogram for all of them.

        The ranges to split go along as a small table, joined on the slot: a row of the
        histogram meets only the ranges of its own slot.
        """
        targets = targets[:SPLITS_PER_JOB]
        fanout = fanout or FANOUT
        chosen = [(s, self._buckets[s][i]) for s, i in targets]
        number = pa.decimal128(38, 0)
        ranges = self._hist.sparkSession.createDataFrame(
            pa.table(
                {
                    "target": pa.array(range(len(chosen)), pa.int32()),
                    "series": pa.array([s for s, _ in chosen], pa.int32()),
                    "slot": pa.array([b.slot for _, b in chosen], pa.int32()),
                    "start": pa.array([Decimal(b.low) for _, b in chosen], number),
                    "end": pa.array([Decimal(b.high) for _, b in chosen], number),
                    "factor": [fanout / (b.high - b.low) for _, b in chosen],
                }
            )
        )
        finer: dict[int, list[Bucket]] = {n: [] for n in range(len(chosen))}
        summed = (
            self._hist.join(F.broadcast(ranges), ["series", "slot"])
            .filter(F.col("value").between(F.col("start"), F.col("end")))
            .groupBy("target", _step(F.col("start"), F.col("factor"), fanout))
            .agg(*_totals())
        )
        for row in summed.collect():
            finer[row["target"]].append(_bucket(row, chosen[row["target"]][1].slot))
        replaced: dict[object, dict[int, list[Bucket]]] = {}
        for n, (s, i) in enumerate(targets):
            replaced.setdefault(s, {})[i] = sorted(finer[n], key=lambda b: b.low)
        for s, parts in replaced.items():
            self._store(
                s, [x for i, b in enumerate(self._buckets[s]) for x in parts.get(i, (b,))]
            )


def _totals() -> list[Column]:
    return [
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.sum("rows").alias("rows"),
        F.sum(F.col("value") * F.col("rows")).alias("total"),
    ]


def _bucket(row, slot: int) -> Bucket:
    return Bucket(slot, int(row["low"]), int(row["high"]), row["rows"], int(row["total"]))


def _step(start: Column, factor: Column, fanout: int) -> Column:
    """Which of ``fanout`` equal steps from the start of a range a value lies in.

    Rounding here only shifts step edges: the step never falls as the value rises,
    the lowest value is in the first and the highest in the last, so every split
    makes progress.
    """
    offset = (F.col("value") - start).cast("double")
    return F.least(F.floor(offset * factor).cast("int"), F.lit(fanout - 1))
