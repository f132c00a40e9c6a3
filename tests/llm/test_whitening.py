import numpy as np
import pytest

from tallyfold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x int, `n` int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", 0, 0) for i, v in vectors], SCHEMA).repartition(3)


def vectors(count, d, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * np.linspace(3, 0.2, d)
    return [(i, [float(c) for c in v]) for i, v in enumerate((rng.standard_normal((count, d)) @ mix.T + 5).astype(np.float32))]


def brute(given, k):
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in given if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        w = (x - sums / n) @ axes / np.sqrt(values)
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        out.setdefault(i, []).append((n, deviation, w, values / (centred**2).sum() * n))
    return out


@pytest.mark.parametrize("d", [1, 3, 24])
def test_rows_equal_a_dense_eigensolver(spark, d):
    given = vectors(300, d) + vectors(40, d) + [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("-inf")] * d)]
    k = min(4, d)
    got = whitening.whiten(table(spark, given), components=4).collect()
    wanted = brute(given, k)
    assert len(got) == sum(len(v) for v in wanted.values()) * k
    signs = {}
    for r in got:
        n, deviation, w, explained = wanted[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(w[r.component - 1]), abs=1e-7)
        if abs(w[r.component - 1]) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * w[r.component - 1]))
        assert 0 <= r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_tables_without_components(spark):
    for given in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])]):
        out = whitening.whiten(table(spark, given))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.collect() == []


def test_flat_vectors_give_fewer_components(spark):
    given = [(None, [float(i), 2.0 * i, 3.0]) for i in range(20)]
    assert {r.component for r in whitening.whiten(table(spark, given)).collect()} == {1}


def test_vectors_of_different_lengths_fail(spark):
    with pytest.raises(ValueError, match="from 1 to 2"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviation_is_exact_beyond_doubles():
    x, sums = np.array([[1 << 30, -(1 << 29)]]), np.array([(1 << 31) + 1, 5], dtype=object)
    assert whitening._deviations(x, 2, sums)[0] == 1 + ((1 << 30) + 5) ** 2
    with pytest.raises(OverflowError):
        whitening._deviations(x, 10, sums)


SPECTRA = {
    "spread": np.linspace(10, 0.1, 30),
    "equal": np.ones(30),
    "close": np.r_[[7, 7, 7 - 1e-12, 5, 5 + 1e-9], np.linspace(4.999, 1, 25)],
    "flat": np.r_[[3, 2], np.zeros(28)],
    "mixed": np.r_[[3, 2, 1], -np.ones(27)],
    "tiny": np.linspace(10, 0.1, 30) * 1e-200,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_contour_integrals_find_every_leading_eigenvalue(name):
    spectrum = np.sort(SPECTRA[name])[::-1]
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((30, 30)))
    matrix = q * spectrum @ q.T
    matrix = (matrix + matrix.T) / 2
    for k in (1, 4, 20):
        if name == "mixed" and k > 3:
            continue
        values, axes = whitening.leading(matrix, k)
        positive = spectrum[: min(k, int((spectrum > spectrum[0] * 1e-12).sum()))]
        assert values == pytest.approx(positive, rel=1e-11, abs=spectrum[0] * 1e-13)
        assert np.abs(matrix @ axes - axes * values).max() < 1e-12 * spectrum[0]
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-9


def test_inertia_counts_eigenvalues_above():
    a = np.random.default_rng(2).standard_normal((25, 25))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for s in (-5, -0.1, 0, 0.7, 3):
        assert whitening.inertia(a, s) == (values > s).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_every_interval_counts_what_it_holds():
    values = np.linspace(1, 0, 60)
    found = whitening.intervals(np.diag(values), 40)
    assert sum(n for _, _, n in found) == 40 and max(n for _, _, n in found) <= whitening.SLICE
    for low, high, n in found:
        assert ((values > low) & (values < high)).sum() == n
