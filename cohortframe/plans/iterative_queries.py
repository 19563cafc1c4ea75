"""Queries on iterative and seeded methods: likelihood fits, latent classes, imputation, bootstraps.

Plain SQL cannot say these; ``tests`` compares them with brute force on small fixtures.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.functions import draws
from cohortframe.operators import bccg, bootstrap, classes, impute, mixed, multinomial, quantreg, splines
from cohortframe.operators import posteriors as po
from cohortframe.operators import samples
from cohortframe.operators.aggregate import spearman
from cohortframe.operators.design import design
from cohortframe.operators.inference import pool_multi
from cohortframe.operators.ranks import add_zscore
from cohortframe.plans.fixtures import Data, q6, r6
from cohortframe.plans.group_queries import SPEARMAN_PAIRS, SPEARMAN_SQL
from cohortframe.plans.model_queries import items_by_cohort, ranked_long
from cohortframe.plans.registry import query
from cohortframe.session import bounded

BASIS = ["age_ns1", "age_ns2"]


def adult_rows(d: Data, least: int, *extra: str) -> DataFrame:
    """Adult waves with spline columns, members with at least ``least`` waves."""
    long = ranked_long(d, "cog_std", *extra).filter("age >= 20")
    basis, _ = bounded(splines.ns_lookup(long.select("age"), "age", [], 2))
    return samples.min_observations(long, ["id"], least).join(basis, "age")


def class_moments(d: Data) -> DataFrame:
    return mixed.person_moments(adult_rows(d, 4), ["cohort", "id"], "bmi", BASIS, [])


@query("mdl_multinomial")
def _(d: Data) -> DataFrame:
    probs = ["prob1", "prob2", "prob3"]
    drawn = po.pseudo_class_draws(d.posteriors().select("id", "cohort", *probs), "id", probs, 5, seed=7)
    m = d.imputed(5).filter("imp > 0").select("imp", "id", "male", "survey_weight", "cog", "cohort", "father_class", "mother_edu_level")
    rows = add_zscore(m, "cog", ["imp", "cohort", "male"], "g", "survey_weight").join(drawn.drop("cohort"), ["imp", "id"])
    rows = rows.withColumn("class_ord", F.concat(F.lit("Class "), F.col("pseudo").cast("string")))
    levels = {"cohort": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "father_class": [1, 2, 3, 4, 5, 6]}
    frame, names = design(rows, ["cohort*g", "male", "father_class", "mother_edu_level"], levels, ["imp", "class_ord", "survey_weight"])
    clean = {n: n.replace(":", "_x_") for n in names}
    fits = multinomial.multinomial_logit(
        frame.withColumnsRenamed(clean), "class_ord", ["Class 1", "Class 2", "Class 3"], list(clean.values()), ["imp"], "survey_weight"
    )
    return pool_multi(fits, ["y_level", "term"])


@query("mdl_quantile_reg")
def _(d: Data) -> DataFrame:
    """Estimate of every wave and quantile with its loss and gap, and median and limits of 200 replicates."""
    rows = ranked_long(d, "cog_std")
    fits = quantreg.quantile_regression(
        rows, "bmi", ["cog_std", "male"], ["cohort", "age"], [k / 10 for k in range(1, 10)], "survey_weight", replicates=200, key="id"
    )
    limits = quantreg.bootstrap_summary(fits, ["cohort", "age"]).withColumnRenamed("beta", "median")
    return fits.filter("replicate = 0").drop("replicate").join(limits, ["cohort", "age", "tau", "term"])


@query("mdl_bccg_fit")
def _(d: Data) -> DataFrame:
    rows = ranked_long(d, "cog_std")
    return bccg.bccg_fit(rows, "bmi", ["cog_std", "male"], ["cohort", "age"], replicates=4, key="id", iterations=40)


@query("mdl_growth_curve")
def _(d: Data) -> DataFrame:
    moments = mixed.person_moments(adult_rows(d, 3), ["cohort", "id"], "bmi", BASIS, ["cog_std", "male"])
    fits = mixed.growth_curve(moments, ["cohort"], ["cog_std"], ["male"], cycles=40, tolerance=1e-7)
    return mixed.growth_curve_table(moments, fits, ["cohort"], mixed.coefficient_names(BASIS, ["cog_std"], ["male"]))


@query("mdl_latent_growth")
def _(d: Data) -> DataFrame:
    moments = class_moments(d)
    fits = classes.class_models(moments, 5, random=False, cycles=None, tolerance=1e-9)
    return classes.fit_table(moments, fits, moments.count())


@query("mdl_growth_mixture")
def _(d: Data) -> DataFrame:
    moments = class_moments(d)
    fits = classes.class_models(moments, 5, random=True, cycles=None, tolerance=1e-9)
    table = classes.posterior_table(moments, ["cohort", "id"], fits)
    return table


@query("mdl_random_restarts")
def _(d: Data) -> DataFrame:
    moments = class_moments(d)
    fits, _ = classes.random_restarts(moments, [2, 3, 4], restarts=100, short_cycles=10, cycles=None, tolerance=1e-9)
    return classes.fit_table(moments, fits, moments.count())


@query("mdl_impute_age")
def _(d: Data) -> DataFrame:
    rows = items_by_cohort(d).select("id", "cohort", "age_11", "maths_11", "verbal_11", "reading_11", "nonverbal_11")
    return impute.impute_age(rows, "id", ["cohort"], ["age_11"], ["maths_11", "verbal_11", "reading_11", "nonverbal_11"], sweeps=10)


@query("mdl_impute_chained")
def _(d: Data) -> DataFrame:
    rows = d.study().select("id", "cohort", "male", "cog", "bmi_20", "bmi_40", "father_class", "mother_edu_level")
    return impute.chained_imputation(
        rows, "id", ["cohort", "male"], ["cog", "bmi_20", "bmi_40"],
        {"mother_edu_level": [0, 1], "father_class": [1, 2, 3, 4, 5, 6]}, m=64, sweeps=5, trees=10,
    )


def _spearman_ci_sql(replicates: int) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT cohort, id, '{a}' AS x, '{b}' AS y, CAST({a} AS DOUBLE) AS vx, CAST({b} AS DOUBLE) AS vy FROM members_wide "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in SPEARMAN_PAIRS)
    key = "cohort, x, y, b"
    rank = lambda v: (
        f"sum(w) OVER (PARTITION BY {key} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
        f"- (sum(w) OVER (PARTITION BY {key}, {v}) - 1) / 2")
    return f"""WITH p AS ({pairs}),
      u AS (SELECT *, {draws.hash_uniform_sql('id', 'b')} AS u FROM p, (SELECT unnest(range(1, {replicates + 1})) AS b)),
      w AS (SELECT {key}, vx, vy, {draws.poisson_weight_sql('u')} AS w FROM u),
      r AS (SELECT {key}, w, {rank('vx')} AS rx, {rank('vy')} AS ry FROM w WHERE w > 0),
      s AS (SELECT {key}, sum(w) AS n, sum(w * rx) AS sx, sum(w * ry) AS sy, sum(w * rx * ry) AS sxy, sum(w * rx * rx) AS sxx, sum(w * ry * ry) AS syy FROM r GROUP BY ALL),
      k AS (SELECT cohort, x, y, CASE WHEN (sxx - sx * sx / n) * (syy - sy * sy / n) > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS rho FROM s),
      q AS (SELECT cohort, x, y, quantile_cont(rho, 0.025) AS lci, quantile_cont(rho, 0.975) AS uci FROM k GROUP BY 1, 2, 3),
      e AS ({SPEARMAN_SQL})
      SELECT e.cohort, e.x, e.y, e.n, e.rho, {q6('lci')} AS lci, {q6('uci')} AS uci FROM e JOIN q USING (cohort, x, y)"""


@query("mdl_spearman_ci", _spearman_ci_sql(200))
def _(d: Data) -> DataFrame:
    wide = d.members_wide()
    rho = spearman(wide, SPEARMAN_PAIRS, ["cohort"])
    boots = bootstrap.bootstrap_spearman(wide, "id", SPEARMAN_PAIRS, ["cohort"], 200)
    limits = bootstrap.percentile_interval(boots, "rho", ["cohort", "x", "y"])
    joined = rho.join(limits, ["cohort", "x", "y"])
    return joined.select("cohort", "x", "y", "n", *[r6(c).alias(c) for c in ("rho", "lci", "uci")])
