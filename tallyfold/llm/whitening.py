"""Whitening of embeddings by their leading components, from FEAST's contour integrals.

Spark sums up the distinct vectors, their means first and then their centred products; the
covariance, as many numbers as the square of the dimension, comes to the driver. There the
leading eigenvalues are fenced in by counting: the signs of the pivots of ``V - s`` tell how
many eigenvalues lie on either side of ``s`` (its inertia), so an interval is found by halving
that holds as many as wanted. The projector on the eigenvectors of an interval is an integral
of ``(z - V)^-1`` around it in the complex plane; it is applied to a few random vectors by
quadrature, one solve for each node, and Rayleigh-Ritz takes eigenpairs out of what is left,
again and again until nothing remains of ``V q - e q``. The count of the interval tells
whether one is missing; then more vectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Scratch

#: Steps of a vector's entries to a unit.
SCALE = 256
#: Entries beyond this many steps are refused, so that sums of a batch stay exact.
LARGEST = 1 << 40
#: Nodes of the quadrature on the half circle, eigenvalues of an interval at most, rounds for an interval.
NODES, SLICE, ROUNDS = 8, 16, 40

_EPS = float(np.finfo(float).eps)


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: the positive pivots of Bunch and Parlett's elimination."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size = np.abs(a)
        i = int(size.diagonal().argmax())
        pairs = size - np.diag(size.diagonal())
        p, q = divmod(int(pairs.argmax()), len(a))
        if size[i, i] >= 0.64 * pairs[p, q]:  # fixed value: (1 + sqrt 17) / 8, which bounds growth
            if size[i, i] == 0:
                break  # what is left is zero
            above += a[i, i] > 0
            chosen = [i]
        else:
            above += 1  # a pair of pivots has one of either sign
            chosen = [p, q]
        rest = np.setdiff1d(np.arange(len(a)), chosen)
        side = a[np.ix_(rest, chosen)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(chosen, chosen)], side.T)
        a = (a + a.T) / 2
    return int(above)


def intervals(matrix: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals above one another that hold the ``k`` largest eigenvalues, and more where they are close."""
    reach = float(np.abs(matrix).sum(axis=1).max())  # no eigenvalue is further from 0
    margin = max(1e3 * _EPS * reach, np.finfo(float).tiny)
    bottom, top = -reach - margin, reach + margin

    def cut(low: float, high: float, at_low: int, least: int) -> tuple[float, int]:
        """A point above which the fewest lie, but at least ``least``."""
        while high - low > margin and at_low > least:
            middle = (low + high) / 2
            n = inertia(matrix, middle)
            low, high, at_low = (middle, high, n) if n >= least else (low, middle, at_low)
        return low, at_low

    wanted, found, high, taken = min(k, len(matrix)), [], top, 0
    while taken < wanted:
        low, n = cut(bottom, high, len(matrix), min(wanted, taken + SLICE))
        found.append((low, high, n - taken))
        high, taken = low, n
    return found


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in ``(low, high)``, falling, and their unit eigenvectors as columns.

    Fails if so many are not found however many vectors are taken.
    """
    d = len(matrix)
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (points + 1))
    norm = float(np.abs(matrix).max()) or 1.0
    enough, random = 32 * _EPS * norm * np.sqrt(d), np.random.default_rng(seed)
    width = min(d, 2 * count + 8)
    while True:
        basis = random.standard_normal((d, width))
        last = np.inf
        for _ in range(ROUNDS):
            filtered = np.zeros((d, basis.shape[1]))
            for turn, weight in zip(turns, weights, strict=True):
                z = centre + radius * turn
                solved = np.linalg.solve(z * np.eye(d) - matrix, basis.astype(complex))
                filtered += (weight / 2 * radius * turn * solved).real
            basis, _ = np.linalg.qr(filtered)
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            basis = basis @ turned
            inside = (values > low) & (values < high)
            misses = np.linalg.norm(matrix @ basis[:, inside] - basis[:, inside] * values[inside], axis=0)
            miss = misses.max(initial=0.0)
            if inside.sum() == count and (miss <= enough or miss >= last / 2 and miss <= 64 * enough):
                order = np.flatnonzero(inside)[::-1]
                return values[order], basis[:, order]
            last = miss if inside.sum() == count else np.inf
        if width == d:
            raise ArithmeticError(f"found {inside.sum()} of {count} eigenvalues between {low} and {high}")
        width = min(d, 2 * width)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    Fewer where the others are zero but for rounding. A vector's largest entry is positive.
    """
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scaled = matrix / size
    parts = [feast(scaled, *interval) for interval in intervals(scaled, k)]
    values = np.concatenate([p[0] for p in parts])[:k]
    vectors = np.concatenate([p[1] for p in parts], axis=1)[:, :k]
    real = values > len(matrix) * _EPS * np.trace(scaled)
    vectors = vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[real] * size, vectors * signs


def steps(vector: Column) -> Column:
    """The entries as whole steps; null for a vector that is null, empty or has null or non-finite entries."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return F.when(F.coalesce(finite & (F.size(vector) > 0), F.lit(False)), whole)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    if len(out) and max(out.max(), -out.min()) >= LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST} steps")
    return out


def _summed(fit: DataFrame, d: int, kind: str, part) -> dict[int, object]:
    """``part`` of the matrix of each batch, an array as long for all, summed up over all rows, by place."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = part(_matrix(batch.column(0), d)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    rows = fit.select("x").mapInArrow(sums, f"at long, value {kind}").groupBy("at")
    total = F.sum(F.col("value").cast("decimal(38,0)") if kind == "long" else "value")
    return {r["at"]: r["value"] for r in rows.agg(total.alias("value")).collect()}


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum over dimensions of the squares of ``n * x - sums``, exact; what is beyond a long fails."""
    reach = n * max(int(np.abs(x).max(initial=0)), 1) + max(abs(int(s)) for s in sums)
    if reach * reach * x.shape[1] < 1 << 63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1)
    exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    if max(exact, default=0) >= 1 << 63:
        raise OverflowError("a deviation is beyond 64 bits")
    return exact.astype(np.int64)


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(``key``, component, n, deviation, whitened, explained, identity_error) for each row with a vector and each component.

    Entries become whole steps, ``floor(SCALE * entry)``. The model is fitted on each distinct
    vector once: ``n`` vectors with sums S by dimension. Components are unit eigenvectors of
    their covariance (divisor n), numbered from 1 by falling eigenvalue e; ``whitened`` is
    ``x - S / n`` projected on one, over the root of e; ``explained`` is e by the sum of all;
    ``deviation`` is the sum of ``(n * x - S) ** 2``, exact; ``identity_error`` is how far the
    covariance of the whitened vectors is from the identity at most.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; repeated
    rows come back as often; keys may be null and may be repeated. Other columns are not read.
    Where fewer eigenvalues differ from zero, fewer components are returned: none for an empty
    table, a single vector, or vectors that are all the same. Vectors of different lengths, and
    entries of ``LARGEST`` steps, fail. The driver holds the covariance, whose size depends on
    the vectors' length alone. Equal eigenvalues share a space, in which any axes are right.
    """
    scratch = Scratch(table.sparkSession)
    rows = scratch.write(table.select(F.col(key).alias("key"), steps(F.col(vector)).alias("x")).where("x IS NOT NULL"))
    fit = scratch.write(rows.select("x").distinct())
    n, shortest, d = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest != d:
        raise ValueError(f"vectors have from {shortest} to {d} entries")
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = f"key {rows.schema['key'].dataType.simpleString()}, {schema}"
    if not n:
        return table.sparkSession.createDataFrame([], named).withColumnRenamed("key", key)
    total = _summed(fit, d, "long", lambda x: x.sum(axis=0))
    sums = np.array([int(total[i]) for i in range(d)], dtype=object)
    means = np.array([float(Fraction(s, n)) for s in sums])
    upper = np.triu_indices(d)
    products = _summed(fit, d, "double", lambda x: ((x - means).T @ (x - means))[upper])
    covariance = np.zeros((d, d))
    covariance[upper] = [products[i] / n for i in range(len(upper[0]))]
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    values, vectors = leading(covariance, components)
    axes, k = vectors / np.sqrt(values), len(values)
    explained = values / np.trace(covariance) if k else values

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - means) @ axes
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _summed(fit, d, "double", moments) if k else {}
    moment = np.array([found[i] / n for i in range(k + k * k)])
    white = moment[k:].reshape(k, k) - np.outer(moment[:k], moment[:k])
    error = float(np.abs(white - np.eye(k)).max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)),
                    pa.array(np.repeat(_deviations(x, n, sums), k)),
                    pa.array(((x - means) @ axes).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, named).withColumnRenamed("key", key)
