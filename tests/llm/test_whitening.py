import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import whitening


def brute(rows, wanted=4):
    """{(id, component): (n, deviation, |whitened|, explained)} and the eigengaps, with exact sums and a full decomposition."""
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][: wanted + 1], vectors[:, ::-1]
    out = {}
    for i, x in usable:
        y = np.array([float(n * c - s) / n for c, s in zip(x, sums)])
        for k in range(min(wanted, d)):
            out[i, k + 1] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), abs(y @ vectors[:, k]) / values[k] ** 0.5, values[k] / (centred**2).sum() * n)
    return out, values


def test_query_against_brute_force(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted, values = brute(rows)
    found = whitening.op11(spark, folder)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    assert len(found) == len(wanted) and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    gap = (-np.diff(values)).min() / values[0]
    for r in found:
        n, deviation, size, explained = wanted[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, abs=1e-11 / gap) and r.explained == pytest.approx(explained, rel=1e-9)
    signs = {}
    for r in found:
        if wanted[r.vec_id, r.component][2] > 0.1:
            signs.setdefault(r.component, set())
    assert set(signs) == {1, 2, 3, 4}


def spectrum(values, seed=3):
    draws = np.random.default_rng(seed)
    turn = np.linalg.qr(draws.standard_normal((len(values), len(values))))[0]
    return turn * np.array(values) @ turn.T


@pytest.mark.parametrize("values", [
    np.arange(1, 41.0), 0.5 ** np.arange(40), np.r_[np.ones(39), 1 + 1e-9], np.r_[np.ones(20), np.full(20, 2.0)], np.r_[np.zeros(38), 1, 2.0],
    np.r_[np.ones(30), 5, 5, 5, 5, 5, 5.0], [7.0], [1.0, 1e-14], 1e-200 * np.arange(1, 11.0), 1e200 * np.arange(1, 11.0),
])
def test_contour_components_of_hard_spectra(values):
    matrix = spectrum(values)
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading(matrix, 4)
    wanted = np.sort(values)[::-1][:4]
    assert np.allclose(found, wanted, rtol=0, atol=1e-13 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(wanted)), atol=1e-13)
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-13 * max(values)


def test_inertia_counts():
    matrix = spectrum([-2.0, -1, 0, 1, 1, 4])
    form = whitening.tridiagonal(matrix)
    assert [whitening.above(form, s) for s in (-3, -1.5, -0.5, 0.5, 1.5, 5)] == [6, 5, 4, 3, 1, 0]
    low = whitening.lower_end(form, 2, -5.0, 5.0)
    assert whitening.above(form, low) == 3  # equal eigenvalues are not cut
    assert 1 < whitening.lower_end(form, 1, -5.0, 5.0) < 4


def test_projection_keeps_only_the_interval():
    matrix = np.diag([1.0, 2, 3, 10])
    assert np.allclose(whitening.projected(matrix, np.eye(4), 8.0, 12.0, nodes=16), np.diag([0, 0, 0, 1.0]), atol=1e-4)


def test_sums_are_exact(spark):
    draws = np.random.default_rng(1)
    rows = [[int(x) for x in r] for r in draws.integers(-(2**62), 2**62, (40, 3))] + [[2**63 - 1024, -(2**63 - 1024), 5]]
    fit = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(5)
    space = whitening.counted(fit)[3]
    assert space.n == 41 and list(space.sums) == [sum(r[k] for r in rows) for k in range(3)]
    small = draws.integers(-9, 9, (30, 4))
    assert (whitening.products(small) == small.T @ small).all()
    large = np.array(rows[:5], object)
    assert (whitening.products(large) == large.T @ large).all()
    fields = whitening.deviations(np.array(rows[:2], np.int64), whitening.Space(41, space.sums)).to_pylist()
    wanted = [sum((41 * c - s) ** 2 for c, s in zip(r, space.sums)) for r in rows[:2]]
    assert fields == [w if w < 10**38 else None for w in wanted]


def test_mean_far_from_zero(spark):
    draws = np.random.default_rng(5)
    rows = [(i, [float(np.float32(1e6 + x)) for x in r]) for i, r in enumerate(draws.standard_normal((60, 5)) * [4, 3, 2, 1, 0.5])]
    wanted, _ = brute(rows)
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    for r in found:
        assert abs(r.whitened) == pytest.approx(wanted[r.vec_id, r.component][2], abs=1e-9) and int(r.deviation) == wanted[r.vec_id, r.component][1]
    assert found[0].identity_error < 1e-10


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 0.25]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [1.0, -inf, 1.0]),
        (None, [3.0, 0.5, -1.0]), (7, [1.0, 2.0, 0.5]), (7, [1.0, 2.0, 0.5]), (8, []), (9, [4.0]), (10, [1.0, 2.0, 0.5 + 1e-6]), (11, [0.0, 0.0]), (12, [0.0, 0.0]),
        (13, [3e38, -3e38, 1.0, 2.0]), (14, [1.0, 1.0, 1.0, -0.0]),
    ]
    schema = "vec_id long, embedding array<float>, n string, x string, dim string, component string, whitened string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], schema)
    found = whitening.whitened(df).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == {1, 2, None, 7, 9, 10, 11, 12, 13, 14}
    assert [r.component for r in sorted(by_id[1], key=lambda r: r.component)] == [1, 2, 3] and len(by_id[7]) == 6 and by_id[1][0].n == 3
    assert {(r.component, r.whitened) for r in by_id[1]} == {(r.component, r.whitened) for r in by_id[7]} == {(r.component, r.whitened) for r in by_id[10]}
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in by_id[9]] == [(1, 0, None, 0.0, None)]
    assert all(r.whitened is None and r.identity_error is None for r in by_id[11])
    assert by_id[1][0].identity_error < 1e-9 and [r.whitened is None for r in sorted(by_id[1], key=lambda r: r.component)] == [False, False, True]
    assert by_id[13][0].n == 2 and by_id[13][0].deviation is None  # beyond 38 digits
    assert whitening.whitened(df.limit(0)).collect() == []
    twice = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(df.repartition(7)).collect()}
    assert all(abs(abs(twice[r.vec_id, r.component]) - abs(r.whitened)) < 1e-9 for r in found if r.whitened is not None)
    assert whitening.scaled(df).where(F.size("x") == 0).count() == 1
