"""Fits that run until their tolerance, against plain numpy and against the other plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import classes, mixed, quantreg
from test_models import PANEL, SCHEMA, panel, sample


def plain_em(values, model, theta, steps=20_000):
    """Plain EM steps until nothing changes."""
    last = -np.inf
    for _ in range(steps):
        loglik, theta = classes.em_update(model, theta, classes.mixture_kernel(values, (model, theta)))
        if loglik - last < 1e-11:
            break
        last = loglik
    return loglik


@pytest.mark.parametrize("random", [False, True])
def test_mixtures_reach_the_plain_optimum_on_both_plans(spark, random, monkeypatch):
    moments = mixed.person_moments(spark.createDataFrame(panel(60, 6, gap=14.0), PANEL), ["id"], "y", ["n1", "n2"], [])
    fits = classes.class_models(moments, 2, random=random, cycles=None, tolerance=1e-10)
    assert all(f["converged"] for f in fits.values())
    values = np.array(moments.select(*classes.MOMENTS).collect(), float)
    base, theta = classes.one_class_start(moments, random)
    for k, fit in fits.items():
        model, start = (base, theta) if k == 1 else classes.spread_start(base, fits[1]["theta"], k)
        assert fit["loglik"] >= plain_em(values, model, start) - 1e-3
        assert np.all(np.diff(fit["path"][::2]) >= -1e-7)
    if not random:
        model, start = classes.spread_start(base, fits[1]["theta"], 2)
        passes = classes.fit_classes(moments, {2: model}, {2: start}, 4, 0.0, unit_persons=0)[2]
        units = classes.fit_classes(moments, {2: model}, {2: start}, 4, 0.0)[2]
        assert passes["loglik"] == pytest.approx(units["loglik"], rel=1e-9) and passes["theta"] == pytest.approx(units["theta"], rel=1e-5, abs=1e-6)


def corner_optimum(y, x, w, tau):
    """Least check loss over all fits through as many rows as there are terms."""
    from itertools import combinations

    best = np.inf
    for rows in combinations(range(len(y)), x.shape[1]):
        part = x[list(rows)]
        if abs(np.linalg.det(part)) < 1e-9:
            continue
        r = y - x @ np.linalg.solve(part, y[list(rows)])
        best = min(best, float(np.sum(w * r * (tau - (r < 0)))))
    return best


def test_quantiles_reach_the_exact_optimum(spark):
    data = [r for r in sample(60)]
    df = spark.createDataFrame(data, SCHEMA)
    fits = quantreg.quantile_regression(df, "y", ["x", "z"], ["g"], [0.1, 0.5, 0.8], "w", replicates=2, key="id").collect()
    for g in "ab":
        part = [r for r in data if r[1] == g]
        y, x, w = np.array([r[2] for r in part]), np.column_stack([np.ones(len(part)), [r[3] for r in part], [r[4] for r in part]]), np.array([r[5] for r in part])
        ids = np.array([r[0] for r in part])
        for tau in (0.1, 0.5, 0.8):
            for b in range(3):
                weight = w * quantreg.replicate_weights(ids, np.array([b]), 1)[:, 0]
                mine = [r for r in fits if (r.g, r.tau, r.replicate) == (g, tau, b)]
                exact = corner_optimum(y, x, weight, tau)
                assert mine[0].converged and exact - 1e-9 * exact <= mine[0].loss <= exact * (1 + 2e-9) + 1e-9
                beta = np.array([next(r.beta for r in mine if r.term == t) for t in ("(Intercept)", "x", "z")])
                r = y - x @ beta
                assert np.sum(weight * r * (tau - (r < 0))) == pytest.approx(mine[0].loss, rel=1e-9)


def test_quantiles_by_units_and_by_passes(spark):
    rows = sample(80) + [(900 + i, None, float(i % 7), float(i), 1.0, 1.0) for i in range(12)]  # a missing group, a constant column
    df = spark.createDataFrame(rows, SCHEMA)
    args = dict(y="y", xs=["x", "z"], by=["g"], taus=[0.3], weight="w", replicates=1, key="id")
    units = {(r.g, r.replicate, r.term): r for r in quantreg.quantile_regression(df, **args).collect()}
    passes = {(r.g, r.replicate, r.term): r for r in quantreg.quantile_regression(df.repartition(3), **args, unit_rows=0).collect()}
    assert set(units) == set(passes) and len(units) == 18
    for k, r in units.items():
        assert r.converged and passes[k].converged and r.loss == pytest.approx(passes[k].loss, rel=1e-8)


def test_replicates_without_weight_have_no_fit(spark):
    df = spark.createDataFrame([(i, "a", float(i), float(i % 3), 0.0, 0.0) for i in range(9)], SCHEMA)
    rows = quantreg.quantile_regression(df, "y", ["x"], ["g"], [0.5], "w").collect()
    assert len(rows) == 2 and all(r.beta is None and r.loss is None and r.converged is False for r in rows)


def test_summary_by_source(spark):
    fits = spark.createDataFrame([(i, "x", 0.5, b, float(10 * i + b)) for i in range(3) for b in range(3)], "imp int, term string, tau double, replicate int, beta double")
    rows = {r.type: r for r in quantreg.summary_by_source(fits, []).collect()}
    assert rows["cc"].beta == 1.5 and rows["mi"].beta == 16.5


@pytest.mark.parametrize("random, scaled", [(False, False), (True, False), (True, True)])
def test_sums_by_pattern_of_waves(random, scaled, monkeypatch):
    """Persons seen at the same ages share the matrices of a step: as many solves as patterns and classes, the sums of all persons."""
    rng = np.random.default_rng(5)
    design = np.column_stack([np.ones(5), np.arange(5) / 4, (np.arange(5) / 4) ** 2])
    values = []
    for i in range(400):
        x = np.delete(design, i % 6, axis=0) if i % 6 < 5 else design
        y = 20 + 3 * rng.normal() + rng.normal(size=len(x))
        s = x.T @ x
        values.append([len(x), *s[np.triu_indices(3)], *(x.T @ y), y @ y])
    values = np.array(values)
    model = classes.ClassModel(3, random, scaled)
    theta = model.pack(np.array([0.2, 0.5, 0.3]), rng.normal(size=(3, 3)) + [20, 0, 0], 2.0, np.diag([4.0, 2.0, 1.0]) + 0.3, np.array([0.5, 2.0, 1.0]))
    wanted = classes.mixture_kernel(values, (model, theta))
    seen, solve = [], classes._posterior
    monkeypatch.setattr(classes, "_posterior", lambda s, *rest: seen.append(len(s)) or solve(s, *rest))
    assert classes.Waves(values, 0).sums(model, theta) == pytest.approx(wanted, rel=1e-9, abs=1e-8)
    assert sum(seen) == (18 if random else 0)
    apart = values + np.arange(400)[:, None] * 1e-6  # ages of their own
    assert classes.Waves(apart, 0).sums(model, theta) == pytest.approx(classes.mixture_kernel(apart, (model, theta)), rel=1e-12)


@pytest.mark.parametrize("ties", [False, True])
def test_quantiles_from_the_rows_near_the_plane(spark, ties):
    """The least loss, with tied values, repeated keys, rows without weight, a tie-filled group and a constant column."""
    rng = np.random.default_rng(8)
    n = 1200
    x, z = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    y = 20 + x - z + rng.gamma(2, 2, n) * (1 + 0.3 * np.abs(x))
    if ties:
        x, y = np.round(x), np.round(y / 4)
    rows = [(i // 2, "a" if i % 3 else None, float(y[i]), float(x[i]), float(z[i]) if i % 3 else 1.0, float(i % 4) / 2) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    args = dict(y="y", xs=["x", "z"], by=["g"], taus=[0.1, 0.5, 0.9], weight="w", replicates=3, key="id")
    plain = {(r.g, r.tau, r.replicate): r for r in quantreg.quantile_regression(df, **args).collect()}
    near = {(r.g, r.tau, r.replicate): r for r in quantreg.quantile_regression(df, **args, screen_rows=0).collect()}
    assert set(plain) == set(near) and len(near) == 24
    for k, r in near.items():
        assert r.converged and plain[k].converged and r.loss == pytest.approx(plain[k].loss, rel=3e-9) and r.gap <= 2e-9 * r.loss + 1e-6


def test_replicates_take_few_rows(monkeypatch):
    """The steps of a replicate go over the rows near its plane."""
    rng = np.random.default_rng(3)
    n, taus = 6000, [0.2, 0.6]
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    y = x[:, 1] + rng.normal(size=n)
    models = np.array([(t, b) for t in taus for b in range(9)], float)
    seen, plain = [], quantreg.near_sums
    monkeypatch.setattr(quantreg, "near_sums", lambda x, y, w, *rest: seen.append(w.size) or plain(x, y, w, *rest))
    path = quantreg._Path(models, np.repeat(np.quantile(y, taus), 9), x[:, 1:].mean(0), x[:, 1:].std(0), y.std(), 1.0, 1e-9)
    quantreg._by_screens(path, x, y, np.arange(n), np.ones(n), 1)
    assert path.done.all() and sum(seen) < 25 * len(models) * n
    w, theta, mu = rng.integers(0, 3, (n, 4)).astype(float), rng.normal(size=(4, 2)), np.array([1.0, 1e-3, 1e-6, 1e-9])
    assert plain(x, y, w, theta, 0.3, mu) == pytest.approx(quantreg.barrier_sums(x, y, w, theta, 0.3, mu), rel=1e-7, abs=1e-12)
