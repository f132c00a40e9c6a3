"""The best one-dimensional clusters: k intervals of least squared error, proven, not the best of some starts.

The squared error of k intervals is the sum of all squares, which no choice changes, less the
sum of ``total**2 / rows`` over the intervals; that gain is what is made largest. Optimal
clusters of numbers are intervals, so only the k-1 cuts are sought, by branch and bound over
the range totals of a histogram (``buckets.ValueBuckets``):

* A dynamic program over the edges of ranges gives a choice that can be had, a lower bound.
* Another gives an upper bound for each range and cut: were the cut somewhere in that range,
  its values would add no more than their own squares, whichever side they went to. Squares
  are bounded by range totals, as ``(v - low) * (v - high) <= 0``.
* Ranges whose bound falls short hold no cut and are put together with their neighbours; Spark
  splits the others. This goes on until every range that may hold a cut is one value.

Bounds are in binary numbers with an allowance for rounding, and values are counted from the
mean. What is left is settled in fractions, so no rounding decides; of equally good choices
the one with the lowest first cut is taken, then the lowest second.

The driver holds the ranges that may hold a cut and the runs between them. A cut moved by a
share x of the values costs about x**2, a range of share d hides about d: so near sqrt(n) of
n distinct values stay in question. Where very different cuts are almost equally good, as in
heavy tails with many clusters, more do, at worst all: the driver's memory and work, which is
the square of the ranges, then grow with them, and ``method="lloyd"`` is the one to take.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np

from tallyfold.operators.buckets import FANOUT, ValueBuckets

# Ranges to begin with, and those that a round aims at.
FIRST_RANGES, RANGES = 1024, 2048
# Gains of pairs of ranges that are worked out at a time.
CELLS = 1 << 22


def best_cuts(buckets: ValueBuckets, series: object, k: int) -> list[tuple[int, int]]:
    """Up to k-1 cuts, rising: the values (in units) below and above each. Fewer where there are fewer values."""
    every = max(1, len(buckets.ranges(series)) // FIRST_RANGES)
    highs = [b.high for b in buckets.ranges(series)]
    edges = highs[every - 1 :: every]
    if edges[-1:] != highs[-1:]:
        edges.append(highs[-1])
    closed: set[int] = set()
    while True:
        spans = _Spans(buckets, series, edges, closed)
        open_ = spans.with_cuts(k)
        wide = [i for i in open_ if not spans.single(i)]
        if not wide:
            return spans.settled(k)
        edges, closed = _finer(buckets, series, spans, open_, max(2, min(FANOUT, RANGES // len(open_))))


def _finer(buckets: ValueBuckets, series: object, spans: _Spans, open_: list[int], parts: int) -> tuple[list[int], set[int]]:
    """Edges of the next round, and those of them that end a run without cuts.

    Such runs are put together and stay closed, the other ranges are cut into up to ``parts`` parts.
    """
    ranges = buckets.ranges(series)
    wanted = {spans.first[i]: (spans.first[i], spans.last[i]) for i in open_}
    lone = [a for a, b in wanted.values() if a == b and ranges[a].low < ranges[a].high]
    bounds = [(ranges[a].low, ranges[b].high) for a, b in wanted.values()]
    buckets.refine(series, lone, parts)
    highs = [b.high for b in buckets.ranges(series)]
    lows = [b.low for b in buckets.ranges(series)]
    edges: set[int] = set()
    for low, high in bounds:
        a, b = bisect_right(lows, low) - 1, bisect_right(lows, high) - 1
        step = -(-(b - a + 1) // parts)
        edges.update(highs[a : b + 1 : step])
        edges.add(highs[b])
    before = {highs[a - 1] for low, _ in bounds if (a := bisect_right(lows, low) - 1)}
    closed = (before | {highs[-1]}) - edges
    return sorted(edges | closed), closed


class _Spans:
    """Runs of neighbouring ranges, each up to one of ``edges``, with their totals from the mean.

    Those up to one of ``closed`` are known to hold no cut.
    """

    def __init__(self, buckets: ValueBuckets, series: object, edges: list[int], closed: set[int]):
        ranges = buckets.ranges(series)
        highs = [b.high for b in ranges]
        self.last = [bisect_right(highs, e) - 1 for e in edges]
        self.first = [0, *(i + 1 for i in self.last[:-1])]
        self.low = [ranges[i].low for i in self.first]
        self.high = [ranges[i].high for i in self.last]
        mean = buckets.total(series) // buckets.rows(series)
        rows = [0, *accumulate(b.rows for b in ranges)]
        total = [0, *accumulate(b.total - b.rows * mean for b in ranges)]
        square = [0, *accumulate(_squares(b.low - mean, b.high - mean, b.rows, b.total - b.rows * mean) for b in ranges)]
        ends = [0, *(i + 1 for i in self.last)]
        self._rows, self._total = [rows[i] for i in ends], [total[i] for i in ends]
        self.n, self.t = np.array(self._rows, float), np.array(self._total, float)
        squares = zip(edges, ends, ends[1:])
        self.q = np.array([-np.inf if e in closed else float(square[b] - square[a]) for e, a, b in squares])
        largest = max(abs(self.low[0] - mean), abs(self.high[-1] - mean))
        # rounding of a gain t * t / n is a few units in the last place of the largest t, times t / n
        self._slack = 64 * np.finfo(float).eps * (float(largest) * float(np.abs(self.t).max()) + float(square[-1]))

    def __len__(self) -> int:
        return len(self.q)

    def single(self, i: int) -> bool:
        return self.low[i] == self.high[i]

    def _gains(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Gain of the interval from edge ``starts`` to edge ``ends``; 0 if it is empty, never if it is less."""
        n, t = self.n[ends] - self.n[starts], self.t[ends] - self.t[starts]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(ends < starts, -np.inf, np.where(n > 0, t * t / n, 0.0))

    def _best(self, sources: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each of ``ends`` the largest of ``sources`` plus the gain from its start to there."""
        found = np.empty(len(ends))
        step = max(1, CELLS // len(starts))
        for i in range(0, len(ends), step):
            found[i : i + step] = (sources + self._gains(starts[None, :], ends[i : i + step, None])).max(axis=1)
        return found

    def _best_back(self, sources: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each of ``starts`` the largest of ``sources`` plus the gain from there to its end."""
        found = np.empty(len(starts))
        step = max(1, CELLS // len(ends))
        for i in range(0, len(starts), step):
            found[i : i + step] = (sources + self._gains(starts[i : i + step, None], ends[None, :])).max(axis=1)
        return found

    def _upto(self, k: int) -> Iterator[np.ndarray]:
        """Largest gains of the values up to each edge in 1, 2, .. k intervals, some of them empty."""
        at = np.arange(len(self) + 1)
        gains = self._gains(np.zeros_like(at), at)
        yield gains
        for _ in range(k - 1):
            gains = self._best(gains, at, at)
            yield gains

    def _after(self, k: int) -> Iterator[np.ndarray]:
        """Largest gains of the values after each edge in 1, 2, .. k intervals, some of them empty."""
        at = np.arange(len(self) + 1)
        gains = self._gains(at, np.full_like(at, len(self)))
        yield gains
        for _ in range(k - 1):
            gains = self._best_back(gains, at, at)
            yield gains

    def with_cuts(self, k: int) -> list[int]:
        """The spans that a cut of a best choice may be in, or at an end of."""
        if k == 1:
            return []
        *_, gains = self._upto(k)
        least = gains[-1] - self._slack
        here, after = np.arange(len(self)), np.arange(len(self)) + 1
        # the j-th cut within a span: what the span and all before it can gain
        left = [self._gains(np.zeros_like(here), here) + self.q]
        # what all after it can gain
        right = [self._gains(after, np.full_like(after, len(self)))]
        for _ in range(k - 2):
            left.append(np.maximum(left[-1], self._best(left[-1], after, here) + self.q))
            right.append(np.maximum(right[-1], self._best_back(right[-1] + self.q, after, here)))
        most = np.max([a + b for a, b in zip(left, reversed(right))], axis=0)
        return [int(i) for i in np.flatnonzero(most >= least)]

    def settled(self, k: int) -> list[tuple[int, int]]:
        """The cuts, once they can only be at edges: candidates by binary numbers, the choice by fractions."""
        upto, after = list(self._upto(k)), list(self._after(k))
        least = upto[-1][-1] - self._slack
        end = len(self)
        # by how many intervals are still to come: the edges where they may begin
        places = {k: [0]}
        for j in range(1, k):
            places[j] = [int(e) for e in np.flatnonzero(upto[k - j - 1] + after[j - 1] >= least)]
        best: dict[int, tuple[Fraction, int]] = {e: (self._exact(e, end), end) for e in places[1]}
        chosen = [best]
        for j in range(2, k + 1):
            found: dict[int, tuple[Fraction, int]] = {}
            for e in places[j]:
                reached = [(self._exact(e, f) + best[f][0], -f) for f in places[j - 1] if f >= e]
                if reached:
                    gain, f = max(reached)
                    found[e] = gain, -f
            best = found
            chosen.append(best)
        cuts, e = [], 0
        for best in reversed(chosen[1:]):
            e = best[e][1]
            cuts.append(e)
        return [(self.high[e - 1], self.low[e]) for e in sorted(set(cuts) - {0, end})]

    def _exact(self, start: int, end: int) -> Fraction:
        n, t = self._rows[end] - self._rows[start], self._total[end] - self._total[start]
        return Fraction(t * t, n) if n else Fraction(0)


def _squares(low: int, high: int, rows: int, total: int) -> int:
    """At least the sum of the squares of ``rows`` values from ``low`` to ``high``; just that if they are one value."""
    return (low + high) * total - low * high * rows
