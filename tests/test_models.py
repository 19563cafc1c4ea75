"""Statistical operators against plain numpy on small rows, and the invariants of iterative methods."""

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.functions import draws, normal
from cohortframe.operators import bccg, bootstrap, classes, impute, inference, mixed, multinomial, pca, quantreg, regress, specs
from cohortframe.operators import posteriors as po
from cohortframe.operators import splines
from cohortframe.plans.fixtures import Data


def sample(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    y = 20 + 1.5 * x - z + rng.normal(size=n) * (1 + 0.3 * np.abs(x))
    w = 0.5 + rng.integers(0, 3, n) / 2
    return [(i, "ab"[i % 2], float(y[i]), float(x[i]), float(z[i]), float(w[i])) for i in range(n)]


SCHEMA = "id long, g string, y double, x double, z double, w double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(sample(), SCHEMA).cache()


def arrays(g):
    part = np.array([r[2:] for r in sample() if r[1] == g])
    return part[:, 0], np.column_stack([np.ones(len(part)), part[:, 1], part[:, 2]]), part[:, 3]


def test_normal_functions(spark):
    z = [-9.0, -4.2, -3.0, -1.0, 0.0, 0.3, 2.999, 3.001, 6.5]
    df = spark.createDataFrame([(v,) for v in z], "z double").coalesce(1)
    got = [r[0] for r in df.select(normal.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rel=1e-9)
    p = [1e-12, 1e-6, 0.02, 0.3, 0.5, 0.8, 0.9999]
    df = spark.createDataFrame([(v,) for v in p], "p double").coalesce(1)
    got = [r[0] for r in df.select(normal.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-9, abs=1e-12)


def test_t_distribution():
    assert normal.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert normal.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert normal.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-10)


def test_draws_agree_between_numpy_and_spark(spark):
    df = spark.range(2000).select("id", draws.hash_uniform(F.col("id"), F.lit(5), 3).alias("u"))
    u = np.array([r.u for r in df.orderBy("id").collect()])
    assert u == pytest.approx(draws.hash_uniform_np(np.arange(2000), np.full(2000, 5), 3), abs=0)
    assert 0.47 < u.mean() < 0.53 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.08
    assert draws.poisson_weight_np(u).mean() == pytest.approx(1, abs=0.1)


def test_wls_hc2_matches_matrix_formula(rows):
    got = {(r.g, r.term): r for r in regress.wls_hc2(rows, "y", ["x", "z"], ["g"], "w").collect()}
    for g in "ab":
        y, x, w = arrays(g)
        a = np.linalg.inv(x.T @ (x * w[:, None]))
        beta = a @ x.T @ (w * y)
        e = y - x @ beta
        h = w * np.einsum("ij,jk,ik->i", x, a, x)
        v = a @ (x.T @ (x * (w**2 * e**2 / (1 - h))[:, None])) @ a
        for i, term in enumerate(["(Intercept)", "x", "z"]):
            r = got[(g, term)]
            assert r.beta == pytest.approx(beta[i], abs=1e-9)
            assert r.se == pytest.approx(math.sqrt(v[i, i]), abs=1e-9)
            assert r.lci == pytest.approx(r.beta - normal.t_quantile(0.975, len(y) - 3) * r.se)
            assert 0 <= r.pval <= 1


def test_dependent_columns_are_null_and_weights_scale(rows):
    twice = rows.withColumn("x2", F.col("x") * 2).withColumn("w9", F.col("w") * 9)
    got = {(r.g, r.term): r for r in regress.wls_hc2(twice, "y", ["x", "x2"], ["g"], "w").collect()}
    assert got[("a", "x2")].beta is None
    more = {(r.g, r.term): r for r in regress.wls_hc2(twice, "y", ["x"], ["g"], "w9").collect()}
    assert more[("a", "x")].beta == pytest.approx(got[("a", "x")].beta)
    assert more[("a", "x")].se == pytest.approx(got[("a", "x")].se)


def test_pooling_one_and_many(spark):
    fits = [("p", 1, 1.0, 0.5, 100.0), ("p", 2, 1.4, 0.6, 100.0), ("p", 3, 0.9, 0.5, 100.0), ("one", 1, 2.0, 0.3, 50.0)]
    df = spark.createDataFrame(fits, "k string, imp int, beta double, se double, df double")
    got = {r.k: r for r in inference.pool_rubin(df, ["k"]).collect()}
    b = np.array([1.0, 1.4, 0.9])
    total = np.mean([0.25, 0.36, 0.25]) + 4 / 3 * b.var(ddof=1)
    lam = 4 / 3 * b.var(ddof=1) / total
    old, obs = 2 / lam**2, 101 / 103 * 100 * (1 - lam)
    assert got["p"].beta == pytest.approx(1.1) and got["p"].se == pytest.approx(math.sqrt(total))
    assert got["p"].df == pytest.approx(old * obs / (old + obs))
    assert got["one"].se == pytest.approx(0.3) and got["one"].df == pytest.approx(51 / 53 * 50)
    multi = {r.k: r for r in inference.pool_multi(df, ["k"]).collect()}
    assert multi["p"].df == pytest.approx(old) and multi["one"].lci == pytest.approx(2 - 1.959964 * 0.3, abs=1e-5)


def test_spline_lookup_is_natural():
    x = np.linspace(20, 46, 53)
    basis = splines.natural_spline(x, 2)
    assert basis[0] == pytest.approx([0, 0], abs=1e-12)
    second = np.diff(basis, 2, axis=0) / (x[1] - x[0]) ** 2
    assert np.abs(second[0]).max() < 1e-2 and np.abs(second[-1]).max() < 1e-2
    assert splines.natural_spline(np.arange(11.0), 3)[-1] == pytest.approx([-1 / 7, 3 / 7, 5 / 7])


def test_spline_columns_span_the_lookup(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(11)], "g string, x double")
    rows = splines.add_natural_columns(df, "x", ["g"], 3, "n").orderBy("x").collect()
    own = np.array([[1.0, r.n1, r.n2, r.n3] for r in rows])
    target = splines.natural_spline(np.arange(11.0), 3)
    assert np.abs(own @ np.linalg.lstsq(own, target, rcond=None)[0] - target).max() < 1e-9


def test_pca_matches_numpy(rows):
    fit = pca.first_component(rows, ["y", "x", "z"], ["g"]).filter("g = 'a'").first()
    part = np.array([r[2:5] for r in sample() if r[1] == "a"])
    values, vectors = np.linalg.eigh(np.corrcoef(part.T))
    loading = vectors[:, -1] * math.sqrt(values[-1])
    assert fit.eigenvalue == pytest.approx(values[-1])
    assert np.abs(fit.loadings) == pytest.approx(np.abs(loading)) and sum(fit.loadings) > 0
    s = pca.pca_summary(rows, ["y", "x", "z"], ["g"]).first()
    assert 1 / 3 <= s.prop <= 1


def test_bootstrap_moments_match_row_weights(rows):
    got = {(r.g, r.replicate): r.beta for r in bootstrap.bootstrap_wls(rows, "id", "y", ["x"], ["g"], 3).filter("term = 'x'").collect()}
    part = [r for r in sample() if r[1] == "a"]
    ids = np.array([r[0] for r in part])
    w = draws.poisson_weight_np(draws.hash_uniform_np(ids, np.full(len(ids), 2)))
    x = np.column_stack([np.ones(len(part)), [r[3] for r in part]])
    beta = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * np.array([r[2] for r in part])))
    assert got[("a", 2)] == pytest.approx(beta[1])


def test_bootstrap_spearman_matches_expanded_rows(spark):
    data = [(i, "a", float(i * 7 % 23), float(i * 5 % 17)) for i in range(60)]
    df = spark.createDataFrame(data, "id long, g string, x double, y double")
    got = {r.replicate: r.rho for r in bootstrap.bootstrap_spearman(df, "id", [("x", "y")], ["g"], 3).collect()}
    for b in (1, 3):
        w = draws.poisson_weight_np(draws.hash_uniform_np(np.arange(60), np.full(60, b))).astype(int)
        x, y = (np.repeat([r[k] for r in data], w) for k in (2, 3))
        rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        assert got[b] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_quantile_regression_reaches_the_optimum(spark):
    data = [r for r in sample(60, 5)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("g", F.lit("a"))
    fits = quantreg.quantile_regression(df, "y", ["x"], ["g"], [0.2, 0.5], "w").collect()
    y, w = np.array([r[2] for r in data]), np.array([r[5] for r in data])
    x = np.column_stack([np.ones(60), [r[3] for r in data]])
    for tau in (0.2, 0.5):
        loss = lambda b: np.sum(w * (y - x @ b) * (tau - (y - x @ b < 0)))  # noqa: B023, E731
        best = min(loss(np.linalg.solve(x[list(c)], y[list(c)])) for c in combinations(range(60), 2))
        fit = {r.term: r for r in fits if r.tau == tau}
        assert fit["x"].loss <= best * (1 + 1e-4)
        r = y - x @ np.array([fit["(Intercept)"].beta, fit["x"].beta])
        assert w[r < -1e-3].sum() <= tau * w.sum() <= w[r <= 1e-3].sum()


def test_multinomial_score_is_zero_and_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    level = ["u", "v", "t"]
    p = np.exp(np.column_stack([np.zeros(300), 0.5 * x, -0.4 + x]))
    pick = [(rng.random() < np.cumsum(r / r.sum())).argmax() for r in p]
    data = [("a", level[k], float(v), 1.0) for k, v in zip(pick, x)]
    df = spark.createDataFrame(data, "g string, c string, x double, w double")
    got = {(r.y_level, r.term): r for r in multinomial.multinomial_logit(df, "c", level, ["x"], ["g"], "w").collect()}
    theta = np.array([[got[(v, t)].beta for t in ("(Intercept)", "x")] for v in ("v", "t")])
    sums = multinomial.softmax_sums(3, 2)(np.column_stack([np.ones(300), pick, np.ones(300), x]), theta.ravel())
    assert np.abs(sums[1:5]).max() < 1e-3
    assert got[("t", "x")].se == pytest.approx(math.sqrt(np.linalg.inv(sums[5:].reshape(4, 4))[3, 3]), rel=1e-4)


def test_bccg_recovers_and_score_is_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    mu, sigma, nu = 25 + x, 0.12, -0.8
    y = mu * (1 + nu * sigma * rng.normal(size=800)) ** (1 / nu)
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "g string, id long, y double, x double")
    fit = {r.term: r for r in bccg.bccg_fit(df, "y", ["x"], ["g"]).collect()}
    assert fit["x"].converged and fit["x"].mu == pytest.approx(1, abs=0.3)
    assert math.exp(fit["(Intercept)"].sigma) == pytest.approx(0.12, abs=0.02)
    theta = np.array([fit[t][k] for k in ("mu", "sigma", "nu") for t in ("(Intercept)", "x")])
    values = np.column_stack([np.arange(800), np.ones(800), y, np.ones(800), x])
    sums = bccg.bccg_kernel(2, False, 1)(values, (theta, 0))
    assert np.abs(sums[1:7]).max() < 0.05
    step = 1e-5
    for i in range(6):
        up, down = theta.copy(), theta.copy()
        up[i] += step
        down[i] -= step
        k = bccg.bccg_kernel(2, False, 1)
        assert (k(values, (up, 0))[0] - k(values, (down, 0))[0]) / (2 * step) == pytest.approx(sums[1 + i], abs=0.05)


def panel(persons=150, seed=4, gap=0.0):
    rng = np.random.default_rng(seed)
    ages = np.array([20.0, 25, 30, 35, 40])
    basis = splines.natural_spline(ages, 2)
    out = []
    for i in range(persons):
        c, shift = rng.normal(), gap * (i % 2)
        b = rng.multivariate_normal([0, 0, 0], np.diag([4, 1, 1]))
        for a, n in zip(ages, basis):
            y = 22 + shift + 3 * n[0] + 2 * n[1] + c * (0.8 + 0.5 * n[0]) + b @ [1, *n] + rng.normal()
            out.append((i, "a", float(a), float(y), float(n[0]), float(n[1]), float(c)))
    return out


PANEL = "id long, g string, age double, y double, n1 double, n2 double, c double"


def test_growth_curve_matches_dense_likelihood(spark):
    data = panel()
    df = spark.createDataFrame(data, PANEL)
    moments = mixed.person_moments(df, ["g", "id"], "y", ["n1", "n2"], ["c"])
    fit = mixed.growth_curve(moments, ["g"], ["c"], [], cycles=25)[("a",)]
    assert np.all(np.diff(np.maximum.accumulate(fit["path"])) >= 0)

    def dense(d, sigma2):
        total, xx, xy = 0.0, np.zeros((6, 6)), np.zeros(6)
        parts = []
        for i in range(150):
            part = np.array([r[3:] for r in data if r[0] == i])
            z = np.column_stack([np.ones(len(part)), part[:, 1:3]])
            x = np.column_stack([z, part[0, 3] * z])
            v = np.linalg.inv(z @ d @ z.T + sigma2 * np.eye(len(part)))
            xx, xy = xx + x.T @ v @ x, xy + x.T @ v @ part[:, 0]
            parts.append((part[:, 0], x, v))
        beta = np.linalg.solve(xx, xy)
        for y, x, v in parts:
            e = y - x @ beta
            total += len(y) * math.log(2 * math.pi) - np.linalg.slogdet(v)[1] + e @ v @ e
        return beta, -0.5 * (total + np.linalg.slogdet(xx)[1] - 6 * math.log(2 * math.pi))

    beta, loglik = dense(fit["D"], fit["sigma2"])
    assert fit["beta"] == pytest.approx(beta, abs=1e-6) and fit["loglik"] == pytest.approx(loglik, abs=1e-5)
    for factor in (0.9, 1.1):
        assert dense(fit["D"] * factor, fit["sigma2"])[1] < loglik + 0.02
        assert dense(fit["D"], fit["sigma2"] * factor)[1] < loglik + 0.02


@pytest.mark.parametrize("random", [False, True])
def test_classes_are_found_and_likelihood_rises(spark, random):
    df = spark.createDataFrame(panel(120, 6, gap=14.0), PANEL)
    moments = mixed.person_moments(df, ["id"], "y", ["n1", "n2"], [])
    fits = classes.class_models(moments, 2, random=random, cycles=15)
    for fit in fits.values():
        assert np.isfinite(fit["loglik"])
    assert fits[2]["loglik"] > fits[1]["loglik"]
    rows = classes.posterior_table(moments, ["id"], fits).filter("groups = 2").collect()
    assert len(rows) == 120 and all(r.prob1 + r.prob2 == pytest.approx(1) for r in rows)
    found = {r.id: r["class"] for r in rows}
    agree = np.mean([found[i] == found[i % 2] for i in range(120)])
    assert agree > 0.95


def test_em_steps_never_lower_the_likelihood(spark):
    df = spark.createDataFrame(panel(60, 8, gap=5.0), PANEL)
    values = np.array(mixed.person_moments(df, ["id"], "y", ["n1", "n2"], []).select(*mixed.MOMENTS).collect())
    for random, scaled in ((False, False), (True, False), (True, True)):
        base = classes.ClassModel(1, random)
        k, s, t, u = mixed.unpack(values.sum(axis=0, keepdims=True))
        curve = np.linalg.solve(s[0], t[0])
        theta = base.pack([1.0], curve, 3.0, np.eye(3) * 2)
        model, theta = classes.spread_start(base, theta, 3, scaled)
        last = -np.inf
        for _ in range(30):
            loglik, theta = classes.em_update(model, theta, classes.mixture_kernel(values, (model, theta)))
            assert loglik >= last - 1e-7
            last = loglik


def test_restarts_keep_the_best(spark):
    df = spark.createDataFrame(panel(60, 9, gap=8.0), PANEL)
    moments = mixed.person_moments(df, ["id"], "y", ["n1", "n2"], [])
    fits, tried = classes.random_restarts(moments, [2], restarts=4, short_cycles=2, cycles=3, random=False, scaled=False)
    assert fits[2]["loglik"] >= max(t[2] for t in tried) - 1e-6


def test_class_reports(spark):
    long = spark.createDataFrame(
        [(1, 1, "prob1", 1.0), (1, 1, "prob2", 0.0), (2, 2, "prob1", 0.25), (2, 2, "prob2", 0.75)],
        "id int, class int, name string, value double",
    )
    expected = 1 + (0.25 * math.log(0.25) + 0.75 * math.log(0.75)) / (2 * math.log(2))
    assert po.entropy(long, "id", 2).first().entropy == pytest.approx(expected)
    assert [r.class_ord for r in po.class_order(long).orderBy("class").collect()] == ["Class 1", "Class 2"]


def test_chained_imputation_invariants(spark, folder):
    observed = Data(spark, folder).study().select("id", "cohort", "male", "cog", "bmi_20", "mother_edu_level").cache()
    args = dict(ident="id", by=["cohort", "male"], numeric=["cog", "bmi_20"], categorical={"mother_edu_level": [0, 1]}, m=2, sweeps=1, trees=3)
    done = impute.chained_imputation(observed, **args).collect()
    again = {(r.imp, r.id): r for r in impute.chained_imputation(observed.repartition(5), **args).collect()}
    base = {r.id: r for r in observed.collect()}
    donors = {}
    for r in base.values():
        for c in ("cog", "bmi_20"):
            if r[c] is not None:
                donors.setdefault((r.cohort, r.male, c), set()).add(r[c])
    assert len(done) == 2 * len(base)
    for r in done:
        for c in ("cog", "bmi_20"):
            if base[r.id][c] is not None:
                assert r[c] == base[r.id][c]
            else:
                assert r[c] in donors.get((r.cohort, r.male, c), {r[c]})
            assert again[(r.imp, r.id)][c] is not None
        assert r.mother_edu_level in (0, 1)
    assert any(again[(r.imp, r.id)].cog != r.cog for r in done) is False


def test_age_imputation_needs_a_test(spark):
    data = [(i, "a", None if i % 4 == 0 else 10.0 + i / 100, None if i < 8 else float(i)) for i in range(80)]
    df = spark.createDataFrame(data, "id long, g string, age double, test double")
    out = {r.id: r.age for r in impute.impute_age(df, "id", ["g"], ["age"], ["test"], sweeps=1).collect()}
    assert out[0] is None and out[40] is not None and out[41] == pytest.approx(10.41)


def test_specification_curve_with_many_fits(spark, folder, monkeypatch):
    """The co-grouped, salted second pass gives the same errors as the broadcast one, with missing cohorts and sexes too."""
    from cohortframe.plans.model_queries import study_stack

    grid = specs.Grid(["bmi_40"], ["cog"], ["cog"], {"basic": [], "early": ["birth_weight", "bmi_10"]})
    unknown = {"cohort": F.expr("nullif(cohort, 'BUILDING')"), "male": F.when(F.col("id") % 37 != 0, F.col("male"))}
    stack = study_stack(Data(spark, folder), 1).withColumns(unknown)
    key = lambda r: (r.cohort, r.imp, r.sex, r.sample, r["mod"], r.bmi_score, r.cog_score)
    a = {key(r): r for r in specs.spec_curve(stack, grid).collect()}
    monkeypatch.setattr(specs, "BROADCAST_FITS", 5)
    monkeypatch.setattr(specs, "SALT_ROWS", 10)
    b = {key(r): r for r in specs.spec_curve(stack, grid).collect()}
    assert set(a) == set(b) and len(a) > 20 and None in {k[0] for k in a} and {k[2] for k in a} == {"all", "male", "female"}
    for k in a:
        assert a[k].beta == pytest.approx(b[k].beta) and a[k].se == pytest.approx(b[k].se)
