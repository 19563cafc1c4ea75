"""Queries on regression, pooling, sensitivity, component scores and class reporting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortframe.functions import draws, normal
from cohortframe.functions.clean import lookup
from cohortframe.functions.text import estimate_text
from cohortframe.operators import bootstrap as bs
from cohortframe.operators import inference as inf
from cohortframe.operators import pca
from cohortframe.operators import posteriors as po
from cohortframe.operators import ranks as rk
from cohortframe.operators import regress as rg
from cohortframe.operators import specs as sp
from cohortframe.operators import splines as spl
from cohortframe.operators.classes import class_fit_stats, class_trajectory
from cohortframe.operators.design import design
from cohortframe.operators.growthchart import box_cox_centile, lms_zscore
from cohortframe.operators.impute import imputed_long
from cohortframe.operators.joins import attach_stats
from cohortframe.operators.reshape import sequence_grid
from cohortframe.plans import sql_models as sm
from cohortframe.plans.fixtures import ADULT_BMI, BMI, IMPUTATIONS, Data, q6, r6
from cohortframe.plans.registry import query
from cohortframe.plans.shape_queries import _BRACKET, lms_rows
from cohortframe.session import bounded


def rounded(df: DataFrame, keys: list[str], values: dict[str, int]) -> DataFrame:
    return df.select(*keys, *[r6(c, d).alias(c) for c, d in values.items()])


RANKED_SQL = """cr AS (SELECT id, cohort, male, survey_weight, cog, CASE WHEN cog IS NOT NULL THEN CAST(rank() OVER (PARTITION BY cohort, cog IS NULL ORDER BY cog) - 1 AS DOUBLE)
  / (count(cog) OVER (PARTITION BY cohort) - 1) END AS cog_rank, (cog - avg(cog) OVER (PARTITION BY cohort)) / stddev_samp(cog) OVER (PARTITION BY cohort) AS cog_std FROM members)"""


def ranked_members(d: Data) -> DataFrame:
    m = d.members().select("id", "cohort", "male", "survey_weight", "cog")
    return rk.add_scores(m, "cog", ["cohort"], {"rank": "cog_rank", "std": "cog_std"})


def ranked_long(d: Data, *scores: str) -> DataFrame:
    w = d.waves().select("id", "age", "bmi")
    return w.join(ranked_members(d).select("id", "cohort", "male", "survey_weight", *scores), "id")


_OLS = f"""{RANKED_SQL}, f AS (SELECT cohort, age, count(*) AS n, regr_slope(bmi, cog_rank) AS beta, regr_sxx(bmi, cog_rank) AS sxx,
   regr_syy(bmi, cog_rank) AS syy, regr_sxy(bmi, cog_rank) AS sxy FROM waves JOIN cr USING (id) WHERE cog_rank IS NOT NULL GROUP BY 1, 2),
   ols AS (SELECT cohort, age, n, beta, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se, CAST(n - 2 AS DOUBLE) AS df FROM f)"""


@query(
    "mdl_ols_by_group",
    f"""WITH {_OLS} SELECT cohort, age, n, {q6('beta')} AS beta, {q6('se')} AS se, {q6('beta - se * ' + sm.t975('df'), 5)} AS lci,
        {q6('beta + se * ' + sm.t975('df'), 5)} AS uci FROM ols""",
)
def _(d: Data) -> DataFrame:
    fits = rg.simple_ols(ranked_long(d, "cog_rank"), "bmi", "cog_rank", ["cohort", "age"])
    return rounded(fits, ["cohort", "age", "n"], {"beta": 6, "se": 6, "lci": 5, "uci": 5})


def items_by_cohort(d: Data) -> DataFrame:
    return d.members().select("id", "cohort", "male").join(d.items(), "id", "left")


@query(
    "mdl_residualise_linear",
    "WITH c AS (SELECT m.id, m.cohort, m.male, i.* EXCLUDE (id) FROM members m LEFT JOIN items i ON m.id = i.id), "
    + sm.wls("r", "c", "maths_11", ["age_11", "male"], ["cohort"])
    + f""" SELECT id, {q6('maths_11 - (b_0 + b_1 * age_11 + b_2 * male)', 5)} AS maths_resid_11 FROM c JOIN r_fit USING (cohort)""",
)
def _(d: Data) -> DataFrame:
    out = rg.residualise(items_by_cohort(d), "maths_11", ["age_11", "male"], ["cohort"], "maths_resid_11")
    return out.select("id", r6("maths_resid_11", 5).alias("maths_resid_11"))


@query("mdl_ns_basis")
def _(d: Data) -> DataFrame:
    adult = d.bmi_long().filter(F.col("age") >= 20).select("cohort", "age")
    return spl.ns_lookup(adult, "age", ["cohort"], 2)


_SPLINE = """c AS (SELECT m.id, m.cohort, m.male, i.* EXCLUDE (id) FROM members m LEFT JOIN items i ON m.id = i.id),
  k AS (SELECT cohort, min(age_11) AS k0, quantile_cont(age_11, 0.5) AS k1, max(age_11) AS k2 FROM c GROUP BY 1),
  u AS (SELECT c.*, (age_11 - k0) / (k2 - k0) AS n1, (k1 - k0) / (k2 - k0) AS p FROM c JOIN k USING (cohort)),
  s AS (SELECT *, pow(n1, 3) - pow(greatest(n1 - p, 0), 3) / (1 - p) AS n2 FROM u)"""


@query(
    "mdl_residualise_spline",
    f"WITH {_SPLINE}, " + sm.wls("r", "s", "verbal_11", ["n1", "n2"], ["cohort"])
    + f" SELECT id, {q6('verbal_11 - (b_0 + b_1 * n1 + b_2 * n2)', 4)} AS verbal_resid_11 FROM s JOIN r_fit USING (cohort)",
)
def _(d: Data) -> DataFrame:
    out = spl.residualise_spline(items_by_cohort(d), "verbal_11", "age_11", ["cohort"], "verbal_resid_11")
    return out.select("id", r6("verbal_resid_11", 4).alias("verbal_resid_11"))


@query(
    "agg_missing_audit",
    f"WITH {_SPLINE}, " + sm.wls("r", "s", "maths_11", ["n1", "n2"], ["cohort"], robust=False)
    + f""", t AS (SELECT cohort, count(*) AS n, var_pop(maths_11) * count(*) AS tss FROM s WHERE maths_11 IS NOT NULL AND n1 IS NOT NULL GROUP BY 1),
      g AS (SELECT cohort, 100 * CAST(count(*) FILTER (WHERE age_11 IS NULL AND maths_11 IS NOT NULL) AS DOUBLE) / count(*) AS pct FROM c GROUP BY 1)
      SELECT cohort, t.n, {q6('pct')} AS pct_no_age, {q6('1 - rss / tss')} AS r2 FROM t JOIN g USING (cohort) JOIN r_fit USING (cohort)""",
)
def _(d: Data) -> DataFrame:
    rows = items_by_cohort(d)
    lost = F.count_if(F.col("age_11").isNull() & F.col("maths_11").isNotNull())
    audit = rows.groupBy("cohort").agg((100.0 * lost / F.count(F.lit(1))).alias("pct_no_age"))
    fit = rg.r_squared(spl.add_natural_columns(rows, "age_11", ["cohort"], 2, "ns"), "maths_11", ["ns1", "ns2"], ["cohort"])
    return rounded(fit.join(audit, "cohort"), ["cohort", "n"], {"pct_no_age": 6, "r2": 6})


_WLS_X = ["cog_std", "male", "bmi_10"]


def wls_rows(d: Data) -> DataFrame:
    wide = d.wave_columns().select("id", "bmi_10", "bmi_40")
    return ranked_members(d).join(wide, "id")


@query(
    "mdl_wls_hc2",
    f"WITH {RANKED_SQL}, src AS (SELECT cr.*, bmi_10, bmi_40 FROM cr JOIN wave_columns USING (id)), "
    + sm.wls("r", "src", "bmi_40", _WLS_X, ["cohort"], "survey_weight")
    + " " + " UNION ALL ".join(
        f"""SELECT cohort, '{t}' AS term, n, {q6(f'b_{i}')} AS beta, {q6(f'sqrt(v_{i}_{i})')} AS se, df,
            {q6(f'b_{i} - sqrt(v_{i}_{i}) * ' + sm.t975('df'), 5)} AS lci, {q6(f'b_{i} + sqrt(v_{i}_{i}) * ' + sm.t975('df'), 5)} AS uci FROM r_fit"""
        for i, t in enumerate(["(Intercept)", *_WLS_X])),
)
def _(d: Data) -> DataFrame:
    fits = rg.wls_hc2(wls_rows(d), "bmi_40", _WLS_X, ["cohort"], "survey_weight")
    return rounded(fits, ["cohort", "term", "n"], {"beta": 6, "se": 6, "df": 6, "lci": 5, "uci": 5})


# ---- specification grid ------------------------------------------------------------------------------------------

CLASSES = [1, 2, 3, 4, 5, 6]
MODS = {
    "basic": [],
    "sep": ["father_class", "mother_edu_level"],
    "early": ["birth_weight", "bmi_10"],
    "all": ["birth_weight", "bmi_10", "father_class", "mother_edu_level"],
}
GRID = sp.Grid(
    outcomes=ADULT_BMI, exposures=["cog", "maths_11"], headline=["cog"], mods=MODS,
    factors={"father_class": CLASSES, "mother_edu_level": [0, 1]},
)


def study_stack(d: Data, m: int = IMPUTATIONS) -> DataFrame:
    return d.imputed(m).join(d.items().select("id", "maths_11"), "id", "left")


def _spec_sql() -> str:
    def scores(column: str, stub: str) -> str:
        g = "PARTITION BY cohort, imp, sex"
        rank = f"(rank() OVER ({g}, {column} IS NULL ORDER BY {column}) - 1)"
        return (
            f"{column} AS {stub}_raw, ({column} - avg({column}) OVER ({g})) / stddev_samp({column}) OVER ({g}) AS {stub}_std, "
            f"CAST({rank} AS DOUBLE) / (count({column}) OVER ({g}) - 1) AS {stub}_rank, "
            f"({rank} + CAST(0.5 AS DOUBLE) * count(*) OVER ({g}, {column})) / count({column}) OVER ({g}) AS {stub}_ridit"
        )

    xs = ["cog", "d_sex", "birth_weight", "bmi_10", *[f"cls{k}" for k in CLASSES[1:]], "edu"]
    waves = " UNION ALL ".join(
        f"SELECT *, '{y}' AS bmi_var, '{x}' AS cog_var, {y}_raw AS y_raw, {y}_std AS y_std, {y}_rank AS y_rank, "
        f"{x}_ridit AS x_ridit, {x}_rank AS x_rank, {x}_std AS x_std FROM scored"
        for y in ADULT_BMI for x in ("cog", "maths_11"))
    sep, early = "mod IN ('sep', 'all')", "mod IN ('early', 'all')"
    dummies = ", ".join(f"CASE WHEN {sep} THEN CAST(father_class = {k} AS INTEGER) ELSE 0 END AS cls{k}" for k in CLASSES[1:])
    keys = ["cohort", "imp", "sex", "sample", "bmi_var", "cog_var", "mod", "bmi_score", "cog_score"]
    body = f"""
      stack AS (SELECT i.*, t.maths_11, b.balanced FROM imputed i LEFT JOIN items t ON i.id = t.id JOIN
        (SELECT id, {' AND '.join(y + ' IS NOT NULL' for y in ADULT_BMI)} AS balanced FROM members_wide) b ON i.id = b.id),
      strata AS (SELECT *, 'all' AS sex FROM stack UNION ALL SELECT *, CASE WHEN male = 1 THEN 'male' ELSE 'female' END FROM stack),
      scored AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(ADULT_BMI)}, cog, maths_11), {', '.join(scores(c, c) for c in [*ADULT_BMI, 'cog', 'maths_11'])} FROM strata),
      long AS (SELECT * FROM ({waves}) WHERE y_raw IS NOT NULL AND x_std IS NOT NULL AND (cog_var = 'cog' OR sex = 'all')),
      sampled AS (SELECT *, 'all' AS sample FROM long UNION ALL SELECT *, 'balanced' FROM long WHERE balanced AND cog_var = 'cog'),
      model AS (SELECT cohort, imp, sex, sample, bmi_var, cog_var, mod, bmi_score, cog_score, survey_weight, male AS d_sex,
        CASE bmi_score WHEN 'raw' THEN y_raw WHEN 'std' THEN y_std ELSE y_rank END AS y,
        CASE cog_score WHEN 'ridit' THEN x_ridit WHEN 'rank' THEN x_rank ELSE x_std END AS cog,
        CASE WHEN {early} THEN birth_weight ELSE 0 END AS birth_weight, CASE WHEN {early} THEN bmi_10 ELSE 0 END AS bmi_10,
        {dummies}, CASE WHEN {sep} THEN mother_edu_level ELSE 0 END AS edu
        FROM sampled, (VALUES ('basic'), ('sep'), ('early'), ('all')) m(mod), (VALUES ('raw'), ('std'), ('rank')) o(bmi_score),
             (VALUES ('ridit'), ('rank'), ('std')) e(cog_score) WHERE cog_var = 'cog' OR bmi_score = 'raw'),
      {sm.wls('g', 'model', 'y', xs, keys, 'survey_weight')},
      fits AS (SELECT {', '.join(keys)}, CASE WHEN imp = 0 THEN 'cc' ELSE 'mi' END AS type, b_1 AS beta, sqrt(v_1_1) AS se, df FROM g_fit WHERE v_1_1 > 0),
      {sm.rubin('pooled', 'fits', 'type, cohort, sex, sample, bmi_var, cog_var, mod, bmi_score, cog_score')}"""
    return f"""WITH {body} SELECT type, cohort, sex, sample, bmi_var, cog_var, mod, bmi_score, cog_score, m, {q6('beta', 5)} AS beta,
       {q6('se', 5)} AS se, {q6('df', 2)} AS df FROM pooled"""


@query("mdl_spec_grid", _spec_sql())
def _(d: Data) -> DataFrame:
    pooled = sp.pooled_curve(sp.spec_curve(study_stack(d), GRID))
    keys = ["type", *sp.SPEC_KEYS, "mod", "bmi_score", "cog_score", "m"]
    return rounded(pooled, keys, {"beta": 5, "se": 5, "df": 2})


# ---- pooling -----------------------------------------------------------------------------------------------------

_POOL_ROWS = "src AS (SELECT * FROM imputed WHERE imp > 0)"
_POOL_FITS = (
    _POOL_ROWS + ", " + sm.wls("r", "src", "bmi_40", ["cog", "male"], ["cohort", "imp"], robust=False)
    + ", fits AS (" + " UNION ALL ".join(
        f"SELECT cohort, imp, '{t}' AS term, b_{i} AS beta, sqrt(v_{i}_{i}) AS se, df FROM r_fit"
        for i, t in enumerate(["(Intercept)", "cog", "male"])) + ")"
)


def imputed_fits(d: Data) -> DataFrame:
    """Classic least-squares fits per cohort and imputation, one row per term."""
    rows = d.imputed().filter("imp > 0").select("cohort", "imp", "bmi_40", "cog", F.col("male").cast("double").alias("male"))
    _, fits, means = rg.fit_wls(rows, "bmi_40", ["cog", "male"], ["cohort", "imp"])
    b, v = F.col("beta"), F.col("inverse")
    cx = [F.lit(m) for m in means]
    sigma2 = F.col("rss") / F.col("df")
    intercept = b[0] + cx[2] - cx[0] * b[1] - cx[1] * b[2]
    var0 = v[0] - 2 * cx[0] * v[1] - 2 * cx[1] * v[2] + cx[0] * cx[0] * v[4] + cx[1] * cx[1] * v[8] + 2 * cx[0] * cx[1] * v[5]
    cells = F.array(*[
        F.struct(F.lit(t).alias("term"), est.alias("beta"), F.sqrt(sigma2 * var).alias("se"))
        for t, est, var in (("(Intercept)", intercept, var0), ("cog", b[1], v[4]), ("male", b[2], v[8]))
    ])
    return fits.select("cohort", "imp", "df", F.explode(cells).alias("t")).select("cohort", "imp", "df", "t.*")


@query(
    "mdl_pool_rubin",
    f"WITH {_POOL_FITS}, {sm.rubin('p', 'fits', 'cohort, term')} SELECT cohort, term, m, {q6('beta', 7)} AS beta, {q6('se', 7)} AS se, {q6('df', 3)} AS df FROM p",
)
def _(d: Data) -> DataFrame:
    return rounded(inf.pool_rubin(imputed_fits(d), ["cohort", "term"]), ["cohort", "term", "m"], {"beta": 7, "se": 7, "df": 3})


@query(
    "mdl_pool_normal",
    f"""WITH {_POOL_FITS}, {sm.rubin('p', 'fits', 'cohort, term')} SELECT cohort, term, {q6('beta', 7)} AS beta, {q6('se', 7)} AS se,
        {q6(f'beta - {sm.Z!r} * se', 6)} AS lci, {q6(f'beta + {sm.Z!r} * se', 6)} AS uci FROM p""",
)
def _(d: Data) -> DataFrame:
    pooled = inf.pool_normal(imputed_fits(d), ["cohort", "term"])
    return rounded(pooled, ["cohort", "term"], {"beta": 7, "se": 7, "lci": 6, "uci": 6})


@query(
    "mdl_pool_multi",
    f"""WITH {_POOL_FITS}, {sm.rubin('p', 'fits', 'cohort, term')} SELECT p.cohort, p.term, {q6('beta', 7)} AS beta, {q6('p.se', 7)} AS se,
        {q6('lam * lam / (p.m - 1)', 6)} AS inverse_df FROM p JOIN p_d USING (cohort, term, beta)""",
)
def _(d: Data) -> DataFrame:
    pooled = inf.pool_multi(imputed_fits(d), ["cohort", "term"]).withColumn("inverse_df", 1 / F.col("df"))
    return rounded(pooled, ["cohort", "term"], {"beta": 7, "se": 7, "inverse_df": 6})


# ---- predictions and contrasts -----------------------------------------------------------------------------------

_GRID_SQL = "(SELECT unnest(range(-60, 61)) AS step)"


def _predict_sql() -> str:
    quad = lambda cs: " + ".join(f"{a} * {b} * v_{i}_{j}" for i, a in enumerate(cs) for j, b in enumerate(cs))
    lin = ["1", "x", "mean_male"]
    spl_c = ["1", "n1", "n2", "mean_male"]
    cube = lambda v: f"pow(greatest({v}, 0), 3)"
    return f"""WITH z AS (SELECT imp, cohort, male, survey_weight, bmi_40, (cog - avg(cog) OVER g) / stddev_samp(cog) OVER g AS cog FROM imputed
          WHERE imp > 0 WINDOW g AS (PARTITION BY cohort, imp)),
      k AS (SELECT cohort, imp, min(cog) AS k0, quantile_cont(cog, 0.5) AS k1, max(cog) AS k2, avg(male) AS mean_male FROM z
            WHERE bmi_40 IS NOT NULL AND cog IS NOT NULL GROUP BY 1, 2),
      u AS (SELECT z.*, (cog - k0) / (k2 - k0) AS n1, (k1 - k0) / (k2 - k0) AS p FROM z JOIN k USING (cohort, imp)),
      s AS (SELECT *, pow(n1, 3) - {cube('n1 - p')} / (1 - p) AS n2 FROM u),
      {sm.wls('l', 's', 'bmi_40', ['cog', 'male'], ['cohort', 'imp'], 'survey_weight')},
      {sm.wls('q', 's', 'bmi_40', ['n1', 'n2', 'male'], ['cohort', 'imp'], 'survey_weight')},
      g AS (SELECT cohort, imp, mean_male, step, CAST(step AS DOUBLE) / 20 AS x, (CAST(step AS DOUBLE) / 20 - k0) / (k2 - k0) AS n1,
            (k1 - k0) / (k2 - k0) AS p FROM k, {_GRID_SQL}),
      h AS (SELECT *, ({cube('n1')} - {cube('n1 - 1')}) - ({cube('n1 - p')} - {cube('n1 - 1')}) / (1 - p) AS n2 FROM g),
      fits AS (SELECT cohort, imp, 'linear' AS form, step, x, {' + '.join(f'{c} * b_{i}' for i, c in enumerate(lin))} AS beta, sqrt({quad(lin)}) AS se, df
               FROM h JOIN l_fit USING (cohort, imp)
               UNION ALL SELECT cohort, imp, 'splines', step, x, {' + '.join(f'{c} * b_{i}' for i, c in enumerate(spl_c))}, sqrt({quad(spl_c)}), df
               FROM h JOIN q_fit USING (cohort, imp)),
      {sm.rubin('pooled', 'fits', 'cohort, form, step, x')}
      SELECT cohort, form, x, {q6('beta', 5)} AS beta, {q6('se', 5)} AS se, {q6(f'beta - {sm.Z!r} * se', 4)} AS lci, {q6(f'beta + {sm.Z!r} * se', 4)} AS uci FROM pooled"""


@query("mdl_predict_grid", _predict_sql())
def _(d: Data) -> DataFrame:
    keys = ["cohort", "imp"]
    rows = rk.add_zscore(d.imputed().filter("imp > 0"), "cog", keys, "x").select(
        *keys, "survey_weight", "bmi_40", "x", F.col("male").cast("double").alias("male")
    ).dropna()
    knots, _ = bounded(rk.group_quantiles(rows, "x", keys, [0.0, 0.5, 1.0]))
    rows = attach_stats(rows, knots, keys)
    at = [F.col("quantiles")[i] for i in range(3)]
    rows = rows.withColumns({f"n{i}": c for i, c in enumerate(spl.natural_columns(F.col("x"), at), start=1)})
    frame = attach_stats(knots, bounded(rows.groupBy(*keys).agg(F.avg("male").alias("mean_male")))[0], keys)
    grid = sequence_grid(frame, "x", -60, 60, 20)
    n1, n2 = spl.natural_columns(F.col("x"), at)
    forms = {"linear": (["x", "male"], [F.lit(1.0), F.col("x"), F.col("mean_male")]),
             "splines": (["n1", "n2", "male"], [F.lit(1.0), n1, n2, F.col("mean_male")])}
    parts = []
    for form, (xs, c) in forms.items():
        fits = rg.wls_hc2(rows, "bmi_40", xs, keys, "survey_weight", covariance=True)
        points = grid.select(*keys, "x", F.array(*c).alias("c"))
        parts.append(rg.linear_contrasts(bounded(fits)[0], points, keys, len(c)).withColumn("form", F.lit(form)))
    pooled = inf.pool_normal(reduce(DataFrame.unionByName, parts), ["cohort", "form", "x"], "estimate")
    return rounded(pooled, ["cohort", "form", "x"], {"beta": 5, "se": 5, "lci": 4, "uci": 4})


def _curve_sql() -> str:
    cube = lambda v: f"pow(greatest({v}, 0), 3)"
    quad = " + ".join(f"n{i} * n{j} * v_{i}_{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    return f"""WITH {RANKED_SQL}, r AS (SELECT cohort, age, bmi, cog_rank FROM waves JOIN cr USING (id) WHERE cog_rank IS NOT NULL),
      k AS (SELECT cohort, age, min(cog_rank) AS k0, quantile_cont(cog_rank, CAST(1 AS DOUBLE) / 3) AS k1, quantile_cont(cog_rank, CAST(2 AS DOUBLE) / 3) AS k2,
            max(cog_rank) AS k3 FROM r GROUP BY 1, 2),
      u AS (SELECT r.*, (cog_rank - k0) / (k3 - k0) AS n1, (k1 - k0) / (k3 - k0) AS p1, (k2 - k0) / (k3 - k0) AS p2 FROM r JOIN k USING (cohort, age)),
      s AS (SELECT *, pow(n1, 3) - {cube('n1 - p2')} / (1 - p2) AS n2, {cube('n1 - p1')} / (1 - p1) - {cube('n1 - p2')} / (1 - p2) AS n3 FROM u),
      {sm.wls('f', 's', 'bmi', ['n1', 'n2', 'n3'], ['cohort', 'age'], robust=False)},
      c AS (SELECT DISTINCT cohort, age, cog_rank, n1 * b_1 + n2 * b_2 + n3 * b_3 AS beta, sqrt(greatest({quad}, 0)) AS se FROM s JOIN f_fit USING (cohort, age) WHERE n1 <> 0)
      SELECT cohort, age, {q6('cog_rank')} AS cog_rank, {q6('beta', 5)} AS beta, {q6(f'beta - {sm.Z!r} * se', 4)} AS lci, {q6(f'beta + {sm.Z!r} * se', 4)} AS uci FROM c"""


@query("mdl_spline_curve", _curve_sql())
def _(d: Data) -> DataFrame:
    by = ["cohort", "age"]
    rows = ranked_long(d, "cog_rank").select(*by, "bmi", "cog_rank").dropna()
    rows = spl.add_natural_columns(rows, "cog_rank", by, 3, "ns")
    names = ["ns1", "ns2", "ns3"]
    _, fits, _ = rg.fit_wls(rows, "bmi", names, by)
    curve = attach_stats(rows.select(*by, "cog_rank", *names).distinct(), fits.select(*by, "beta", "inverse", "rss", "df"), by)
    n = [F.col(c) for c in names]
    value = reduce(lambda a, b: a + b, [n[i] * F.col("beta")[i + 1] for i in range(3)])
    variance = reduce(lambda a, b: a + b, [n[i] * n[j] * F.col("inverse")[4 * (i + 1) + j + 1] for i in range(3) for j in range(3)])
    se = F.sqrt(F.greatest(variance * F.col("rss") / F.col("df"), F.lit(0.0)))
    z = normal.Z975
    out = curve.filter(F.col("ns1") != 0).select(*by, "cog_rank", value.alias("beta"), (value - z * se).alias("lci"), (value + z * se).alias("uci"))
    return rounded(out, by, {"cog_rank": 6, "beta": 5, "lci": 4, "uci": 4})


def _contrast_sql() -> str:
    xs = ["n1", "n2", "cog", "cog * n1", "cog * n2"]
    kinds = {"prediction": ["1", "n1", "n2", "g", "g * n1", "g * n2"], "margin": ["0", "0", "0", "g", "g * n1", "g * n2"]}
    parts = []
    for kind, c in kinds.items():
        quad = " + ".join(f"({a}) * ({b}) * v_{i}_{j}" for i, a in enumerate(c) for j, b in enumerate(c) if a != "0" and b != "0")
        value = " + ".join(f"({a}) * b_{i}" for i, a in enumerate(c) if a != "0")
        parts.append(f"SELECT cohort, '{kind}' AS pred_type, age, g, {value} AS beta, sqrt(greatest({quad}, 0)) AS se FROM pts JOIN f_fit USING (cohort)")
    return f"""WITH {RANKED_SQL}, r AS (SELECT cohort, age, bmi, cog_std AS cog, CAST(age - 20 AS DOUBLE) / 20 AS n1 FROM waves JOIN cr USING (id) WHERE age >= 20),
      s AS (SELECT *, pow(n1, 3) - pow(greatest(n1 - 0.5, 0), 3) / 0.5 AS n2 FROM r),
      {sm.wls('f', 's', 'bmi', xs, ['cohort'])},
      pts AS (SELECT DISTINCT cohort, age, n1, n2, g FROM s, (SELECT unnest(range(-1, 2)) AS g)),
      c AS ({' UNION ALL '.join(parts)})
      SELECT cohort, pred_type, age, CAST(g AS INTEGER) AS cog, {q6('beta', 5)} AS beta, {q6('se', 5)} AS se, {q6(f'beta - {sm.Z!r} * se', 4)} AS lci,
        {q6(f'beta + {sm.Z!r} * se', 4)} AS uci FROM c WHERE NOT (pred_type = 'margin' AND g = 0)"""


@query("mdl_contrasts", _contrast_sql())
def _(d: Data) -> DataFrame:
    rows = ranked_long(d, "cog_std").filter(F.col("age") >= 20).select("cohort", "age", "bmi", F.col("cog_std").alias("cog"))
    basis, _ = bounded(spl.ns_lookup(rows.select("cohort", "age"), "age", ["cohort"], 2))
    rows = attach_stats(rows, basis, ["cohort", "age"])
    frame, names = design(rows, ["age_ns1", "age_ns2", "cog", "cog:age_ns1", "cog:age_ns2"], {}, ["cohort", "bmi"])
    frame = frame.withColumnsRenamed({"cog:age_ns1": "c1", "cog:age_ns2": "c2"})
    fits, _ = bounded(rg.wls_hc2(frame, "bmi", ["age_ns1", "age_ns2", "cog", "c1", "c2"], ["cohort"], covariance=True))
    points = basis.withColumn("g", F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)])))
    a1, a2, g, zero = F.col("age_ns1"), F.col("age_ns2"), F.col("g").cast("double"), F.lit(0.0)
    margin = points.filter("g != 0").withColumn("pred_type", F.lit("margin")).withColumn("c", F.array(zero, zero, zero, g, g * a1, g * a2))
    whole = points.withColumn("pred_type", F.lit("prediction")).withColumn("c", F.array(F.lit(1.0), a1, a2, g, g * a1, g * a2))
    both = margin.unionByName(whole).select("cohort", "pred_type", "age", F.col("g").alias("cog"), "c")
    out = rg.linear_contrasts(fits, both, ["cohort"], 6).withColumnRenamed("estimate", "beta")
    z = normal.Z975
    out = out.withColumns({"lci": F.col("beta") - z * F.col("se"), "uci": F.col("beta") + z * F.col("se")})
    return rounded(out, ["cohort", "pred_type", "age", "cog"], {"beta": 5, "se": 5, "lci": 4, "uci": 4})


# ---- sensitivity and attrition -----------------------------------------------------------------------------------


def _mnar_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT i.cohort, i.imp, '{y}' AS bmi_var, i.male, i.survey_weight, i.cog, CAST(step AS DOUBLE) / 10 AS delta,
        i.{y} + CASE WHEN o.{y} IS NULL THEN CAST(step AS DOUBLE) / 10 * sd.s_{y} ELSE 0 END AS bmi
        FROM z i JOIN members_wide o ON i.id = o.id JOIN sd ON i.cohort = sd.cohort, (SELECT unnest(range(-10, 11)) AS step)""" for y in ADULT_BMI)
    return f"""WITH sd AS (SELECT cohort, {', '.join(f'stddev_samp({y}) AS s_{y}' for y in ADULT_BMI)} FROM members_wide GROUP BY 1),
      z AS (SELECT * EXCLUDE (cog), (cog - avg(cog) OVER g) / stddev_samp(cog) OVER g AS cog FROM imputed WHERE imp > 0 WINDOW g AS (PARTITION BY cohort, imp)),
      rows_ AS ({rows}), {sm.wls('f', 'rows_', 'bmi', ['cog', 'male'], ['cohort', 'imp', 'bmi_var', 'delta'], 'survey_weight')},
      fits AS (SELECT cohort, imp, bmi_var, delta, b_1 AS beta, sqrt(v_1_1) AS se, df FROM f_fit), {sm.rubin('p', 'fits', 'cohort, bmi_var, delta')}
      SELECT cohort, bmi_var, delta, {q6('beta')} AS beta, {q6('se')} AS se, {q6('df', 3)} AS df FROM p"""


@query("mdl_mnar_delta", _mnar_sql())
def _(d: Data) -> DataFrame:
    wide = d.members_wide()
    long = wide.select("cohort", *ADULT_BMI).unpivot("cohort", ADULT_BMI, "bmi_var", "bmi")
    sd, _ = bounded(long.groupBy("cohort", "bmi_var").agg(F.stddev_samp("bmi").alias("sd")))
    curve = sp.mnar_curve(d.imputed(), GRID, sd, [s / 10 for s in range(-10, 11)])
    return rounded(curve, ["cohort", "bmi_var", "delta"], {"beta": 6, "se": 6, "df": 3})


_PAIRS_SQL = f"""WITH {_OLS} SELECT x.age, x.cohort AS cohort_x, y.cohort AS cohort_y, y.beta - x.beta AS beta,
  (y.beta - x.beta) / sqrt(x.se * x.se + y.se * y.se) AS z FROM ols x JOIN ols y ON x.age = y.age"""


@query("mdl_pairwise_diff", f"SELECT age, cohort_x, cohort_y, {q6('beta')} AS beta, {q6('z')} AS z, {q6(normal.cdf_sql('z'))} AS p_lower FROM ({_PAIRS_SQL})")
def _(d: Data) -> DataFrame:
    fits, _ = bounded(rg.simple_ols(ranked_long(d, "cog_rank"), "bmi", "cog_rank", ["cohort", "age"]))
    pairs = inf.pairwise_differences(fits, ["age"], ["cohort"])
    return rounded(pairs, ["age", "cohort_x", "cohort_y"], {"beta": 6, "z": 6, "p_lower": 6})


def _attrition_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT cohort, male, '{a}' AS fup_bmi, '{b}' AS fup_miss, survey_weight, ln({a}) AS bmi, CAST({b} IS NULL AS INTEGER) AS miss FROM members_wide"
        for i, a in enumerate(BMI) for b in BMI[i + 1:])
    return f"""WITH rows_ AS ({rows}), {sm.wls('f', 'rows_', 'bmi', ['miss'], ['cohort', 'male', 'fup_bmi', 'fup_miss'], 'survey_weight')}
      SELECT cohort, male, fup_bmi, fup_miss, n, CASE WHEN kept_1 = 1 THEN {q6('b_1')} END AS beta, CASE WHEN kept_1 = 1 THEN {q6('sqrt(v_1_1)')} END AS se, df FROM f_fit"""


@query("mdl_attrition", _attrition_sql())
def _(d: Data) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(a).alias("fup_bmi"), F.lit(b).alias("fup_miss"), F.log(a).alias("bmi"), F.col(b).isNull().cast("double").alias("miss"))
        for i, a in enumerate(BMI) for b in BMI[i + 1:]
    ])
    rows = d.members_wide().select("cohort", "male", "survey_weight", F.explode(cells).alias("c")).select("cohort", "male", "survey_weight", "c.*")
    fits = rg.wls_hc2(rows, "bmi", ["miss"], ["cohort", "male", "fup_bmi", "fup_miss"], "survey_weight").filter("term = 'miss'")
    return rounded(fits, ["cohort", "male", "fup_bmi", "fup_miss", "n"], {"beta": 6, "se": 6, "df": 6})


@query(
    "mdl_lms_zscore",
    _BRACKET + f"SELECT id, age, {q6('CASE WHEN l = 0 THEN ln(bmi / m) / s ELSE (pow(bmi / m, l) - 1) / (l * s) END', 5)} AS z FROM lms",
)
def _(d: Data) -> DataFrame:
    z = lms_zscore(F.col("bmi"), F.col("l"), F.col("m"), F.col("s"))
    return lms_rows(d).select("id", "age", r6(z, 5).alias("z"))


# ---- principal component -----------------------------------------------------------------------------------------

_PCA_ITEMS = ["maths_11", "verbal_11", "reading_11", "nonverbal_11"]
_PCA_SETS = {"g_all_11": _PCA_ITEMS, "g_closer_11": ["maths_11", "verbal_11"]}


def _pca_sql(items: list[str], tag: str, squarings: int = 14) -> str:
    """Dominant eigenvector by repeated squaring of the correlation matrix."""
    p = len(items)
    cells = [(i, j) for i in range(p) for j in range(p)]
    start = ", ".join(("CAST(1 AS DOUBLE)" if i == j else f"corr({items[min(i, j)]}, {items[max(i, j)]})") + f" AS r_{i}_{j}" for i, j in cells)
    stats = ", ".join(f"avg({c}) AS m_{i}, stddev_samp({c}) AS s_{i}" for i, c in enumerate(items))
    parts = [f"{tag}_r AS MATERIALIZED (SELECT cohort, {start}, {stats} FROM c GROUP BY cohort)",
             f"{tag}_0 AS MATERIALIZED (SELECT cohort, {', '.join(f'r_{i}_{j}' for i, j in cells)} FROM {tag}_r)"]
    for k in range(squarings):
        cols = ", ".join("(" + " + ".join(f"r_{i}_{h} * r_{h}_{j}" for h in range(p)) + f") AS q_{i}_{j}" for i, j in cells)
        trace = " + ".join(f"q_{i}_{i}" for i in range(p))
        scaled = ", ".join(f"q_{i}_{j} / ({trace}) AS r_{i}_{j}" for i, j in cells)
        parts.append(f"{tag}_{k + 1} AS MATERIALIZED (SELECT cohort, {scaled} FROM (SELECT cohort, {cols} FROM {tag}_{k}))")
    top = f"{tag}_{squarings}"
    biggest = "CASE greatest(" + ", ".join(f"r_{i}_{i}" for i in range(p)) + ") " + " ".join(
        f"WHEN r_{j}_{j} THEN r_{{i}}_{j}" for j in range(p)) + " END"
    raw = ", ".join(biggest.replace("{i}", str(i)) + f" AS w_{i}" for i in range(p))
    norm = "sqrt(" + " + ".join(f"w_{i} * w_{i}" for i in range(p)) + ")"
    total = " + ".join(f"w_{i}" for i in range(p))
    sign = f"CASE WHEN {total} > 1e-8 * {norm} THEN 1 WHEN {total} < -1e-8 * {norm} THEN -1 WHEN w_0 > 0 THEN 1 ELSE -1 END"
    unit = ", ".join(f"w_{i} / {norm} * {sign} AS v_{i}" for i in range(p))
    parts.append(f"{tag}_v AS MATERIALIZED (SELECT cohort, {unit} FROM (SELECT cohort, {raw} FROM {top}))")
    value = " + ".join(f"v_{i} * v_{j} * r_{i}_{j}" for i, j in cells)
    means = ", ".join(f"m_{i}, s_{i}" for i in range(p))
    parts.append(f"{tag}_e AS MATERIALIZED (SELECT cohort, {', '.join(f'v_{i}' for i in range(p))}, {value} AS lam, {means} FROM {tag}_v JOIN {tag}_r USING (cohort))")
    return ", ".join(parts)


def _pca_score_sql(items: list[str], tag: str) -> str:
    score = " + ".join(f"v_{i} / sqrt(lam) * ({c} - m_{i}) / s_{i}" for i, c in enumerate(items))
    return f"(SELECT id, cohort, {score} AS s FROM c JOIN {tag}_e USING (cohort))"


_PCA_BASE = "c AS (SELECT m.id, m.cohort, i.* EXCLUDE (id) FROM members m LEFT JOIN items i ON m.id = i.id)"


@query(
    "mdl_pca_scores",
    f"WITH {_PCA_BASE}, {_pca_sql(_PCA_ITEMS, 'a')}, {_pca_sql(_PCA_SETS['g_closer_11'], 'b')}, "
    + "z AS (SELECT x.id, (x.s - avg(x.s) OVER w) / stddev_samp(x.s) OVER w AS g_all_11, (y.s - avg(y.s) OVER w) / stddev_samp(y.s) OVER w AS g_closer_11 FROM "
    + f"{_pca_score_sql(_PCA_ITEMS, 'a')} x JOIN {_pca_score_sql(_PCA_SETS['g_closer_11'], 'b')} y USING (id) WINDOW w AS (PARTITION BY x.cohort)) "
    + f"SELECT id, {q6('g_all_11', 4)} AS g_all_11, {q6('g_closer_11', 4)} AS g_closer_11 FROM z",
)
def _(d: Data) -> DataFrame:
    rows = items_by_cohort(d)
    for name, items in _PCA_SETS.items():
        rows = pca.pca_scores(rows, items, ["cohort"], name)
    return rounded(rows, ["id"], {name: 4 for name in _PCA_SETS})


@query(
    "mdl_pca_summary",
    f"WITH {_PCA_BASE}, {_pca_sql(_PCA_ITEMS, 'a')} SELECT cohort, {q6('lam')} AS eigenvalue, CAST(4 AS BIGINT) AS vars, {q6('lam / 4')} AS prop FROM a_e",
)
def _(d: Data) -> DataFrame:
    return rounded(pca.pca_summary(items_by_cohort(d), _PCA_ITEMS, ["cohort"]), ["cohort", "vars"], {"eigenvalue": 6, "prop": 6})


# ---- imputation stack, bootstrap, centiles -----------------------------------------------------------------------


@query("mdl_imputed_long", f"SELECT imp, id, cohort, {', '.join(ADULT_BMI)} FROM imputed")
def _(d: Data) -> DataFrame:
    wide = d.members_wide().select("id", "cohort", *ADULT_BMI)
    filled = d.imputed().filter("imp > 0")
    missing = F.array_compact(F.array(*[
        F.when(F.array_contains("missing_waves", c), F.struct(F.lit(c).alias("variable"), F.col(c).alias("value"))) for c in ADULT_BMI
    ]))
    cells = filled.select("imp", "id", F.explode(missing).alias("c")).select("imp", "id", "c.*")
    return imputed_long(wide, cells, ["id"], ADULT_BMI, IMPUTATIONS)


_BOOTS = 200


@query(
    "mdl_bootstrap",
    f"""WITH {RANKED_SQL}, r AS (SELECT cohort, age, id, bmi, cog_std FROM waves JOIN cr USING (id) WHERE cog_std IS NOT NULL),
      u AS (SELECT cohort, age, bmi, cog_std AS x, b, {draws.hash_uniform_sql('id', 'b')} AS u FROM r, (SELECT unnest(range(1, {_BOOTS + 1})) AS b)),
      w AS (SELECT cohort, age, bmi, x, b, {draws.poisson_weight_sql('u')} AS w FROM u),
      s AS (SELECT cohort, age, b, sum(w) AS sw, sum(w * x) AS sx, sum(w * bmi) AS sy, sum(w * x * bmi) AS sxy, sum(w * x * x) AS sxx FROM w GROUP BY 1, 2, 3),
      k AS (SELECT cohort, age, (sxy - sx * sy / sw) / (sxx - sx * sx / sw) AS beta FROM s)
      SELECT cohort, age, {q6('quantile_cont(beta, 0.5)')} AS median, {q6('quantile_cont(beta, 0.025)')} AS lci, {q6('quantile_cont(beta, 0.975)')} AS uci FROM k GROUP BY 1, 2""",
)
def _(d: Data) -> DataFrame:
    rows = ranked_long(d, "cog_std")
    boots = bs.bootstrap_wls(rows, "id", "bmi", ["cog_std"], ["cohort", "age"], _BOOTS).filter("term = 'cog_std'")
    return rounded(bs.percentile_interval(boots, "beta", ["cohort", "age"]), ["cohort", "age"], {"median": 6, "lci": 6, "uci": 6})


def _centile_sql() -> str:
    q = normal.quantile_sql("tau")
    bmi = f"CASE WHEN nu = 0 THEN mu * exp(sigma * z) WHEN 1 + nu * sigma * z > 0 THEN mu * pow(1 + nu * sigma * z, 1 / nu) END"
    return f"""WITH p AS (SELECT cohort, age, male, avg(bmi) AS mu, stddev_samp(bmi) / avg(bmi) AS sigma,
          round(3 * (avg(bmi) - quantile_cont(bmi, 0.5)) / stddev_samp(bmi), 4) AS nu FROM bmi_long GROUP BY 1, 2, 3),
      g AS (SELECT *, CAST(k AS DOUBLE) / 100 AS tau FROM p, (SELECT unnest(range(1, 100)) AS k)), z AS (SELECT *, {q} AS z FROM g),
      v AS (SELECT cohort, age, k, male, {bmi} AS bmi FROM z)
      SELECT cohort, age, CAST(k AS INTEGER) AS centile, {q6('max(bmi) FILTER (WHERE male = 0)', 5)} AS low, {q6('max(bmi) FILTER (WHERE male = 1)', 5)} AS high,
        {q6('max(bmi) FILTER (WHERE male = 1) - max(bmi) FILTER (WHERE male = 0)', 5)} AS diff FROM v GROUP BY 1, 2, 3"""


@query("mdl_bccg_centiles", _centile_sql())
def _(d: Data) -> DataFrame:
    keys = ["cohort", "age", "male"]
    long = d.bmi_long().select(*keys, "bmi")
    median = rk.group_quantiles(long, "bmi", keys, [0.5])
    sd, mean = F.col("sd"), F.col("mu")
    params = long.groupBy(*keys).agg(F.avg("bmi").alias("mu"), F.stddev_samp("bmi").alias("sd")).join(median, keys).select(
        *keys, "mu", (sd / mean).alias("sigma"), F.round(3 * (mean - F.col("quantiles")[0]) / sd, 4).alias("nu")
    )
    grid = params.withColumn("centile", F.explode(F.sequence(F.lit(1), F.lit(99))))
    value = box_cox_centile(F.col("centile") / 100.0, F.col("mu"), F.col("sigma"), F.col("nu"))
    v = grid.withColumn("bmi", value)
    at = lambda k: F.max(F.when(F.col("male") == k, F.col("bmi")))
    wide = v.groupBy("cohort", "age", "centile").agg(at(0).alias("low"), at(1).alias("high"), (at(1) - at(0)).alias("diff"))
    return rounded(wide, ["cohort", "age", "centile"], {"low": 5, "high": 5, "diff": 5})


# ---- class reporting ---------------------------------------------------------------------------------------------

_ORDER_SQL = """s AS (SELECT CAST(right(name, 1) AS INTEGER) AS class, round(sum(value) * 100 / sum(sum(value)) OVER (), 2) AS class_prop FROM posteriors_long GROUP BY name),
  o AS (SELECT class, class_prop, row_number() OVER (ORDER BY class_prop DESC, class) AS place FROM s)"""


@query(
    "mdl_class_quality",
    f"""WITH {_ORDER_SQL}, a AS (SELECT CAST(right(name, 1) AS INTEGER) AS class, 100 * avg(value) AS mean_prob FROM posteriors_long GROUP BY name),
      m AS (SELECT p.class, o.place, round(avg(value), 3) AS v FROM posteriors_long p JOIN o ON CAST(right(name, 1) AS INTEGER) = o.class GROUP BY 1, 2)
      SELECT 'Class ' || o.place AS class_ord, {q6('max(mean_prob)')} AS mean_prob, max(v) FILTER (WHERE m.place = 1) AS prop1, max(v) FILTER (WHERE m.place = 2) AS prop2,
        max(v) FILTER (WHERE m.place = 3) AS prop3 FROM o JOIN a USING (class) JOIN m USING (class) GROUP BY o.place""",
)
def _(d: Data) -> DataFrame:
    return po.class_quality(d.posteriors_long(), [1, 2, 3]).withColumn("mean_prob", r6("mean_prob"))


@query(
    "mdl_class_fit_stats",
    f"""WITH l AS (SELECT count(*) AS n, sum(ln(greatest(prob1, prob2, prob3))) AS ll, sum(prob1 * ln(prob1) + prob2 * ln(prob2) + prob3 * ln(prob3)) AS s FROM posteriors)
      SELECT CAST(3 AS INTEGER) AS groups, {q6('ll')} AS log_lik, {q6('-2 * ll + 2 * 12')} AS aic, {q6('-2 * ll + 12 * ln(n)')} AS bic,
        {q6('1 + s / (n * ln(3))')} AS entropy FROM l""",
)
def _(d: Data) -> DataFrame:
    wide = d.posteriors()
    log_lik = wide.agg(F.sum(F.log(F.greatest("prob1", "prob2", "prob3")))).first()[0]
    stats = class_fit_stats(d.posteriors_long(), "id", 3, log_lik, 12)
    return rounded(stats, ["groups"], {"log_lik": 6, "aic": 6, "bic": 6, "entropy": 6})


@query(
    "mdl_class_trajectory",
    f"""WITH {_ORDER_SQL}, r AS (SELECT class, bmi, age, CAST(age - 20 AS DOUBLE) / 20 AS n1 FROM waves JOIN posteriors USING (id) WHERE age >= 20),
      q AS (SELECT *, pow(n1, 3) - pow(greatest(n1 - 0.5, 0), 3) / 0.5 AS n2 FROM r), {sm.wls('f', 'q', 'bmi', ['n1', 'n2'], ['class'])},
      p AS (SELECT DISTINCT class, age, n1, n2 FROM q)
      SELECT 'Class ' || place || ' (' || printf('%.1f', class_prop) || '%)' AS class_long, age, {q6('b_0 + b_1 * n1 + b_2 * n2')} AS pred
      FROM p JOIN f_fit USING (class) JOIN o USING (class)""",
)
def _(d: Data) -> DataFrame:
    adult = d.waves().filter("age >= 20").select("id", "age", "bmi").join(d.posteriors().select("id", "class"), "id")
    basis, _ = bounded(spl.ns_lookup(adult.select("age"), "age", [], 2))
    rows = adult.join(basis, "age")
    terms = ["age_ns1", "age_ns2"]
    fits = rg.wls_hc2(rows, "bmi", terms, ["class"]).select("class", "term", "beta")
    pred = class_trajectory(fits, basis, po.class_order(d.posteriors_long()), terms)
    return pred.select("class_long", "age", r6("pred").alias("pred"))


@query(
    "mdl_pseudo_class_draws",
    f"""WITH {_ORDER_SQL}, d AS (SELECT id, cohort, prob1, prob2, prob3, b, {draws.hash_uniform_sql('id', 'b', 7)} * (prob1 + prob2 + prob3) AS u
        FROM posteriors, (SELECT unnest(range(1, 61)) AS b))
      SELECT CAST(b AS INTEGER) AS imp, cohort, id, 'Class ' || o.place AS class_ord FROM d JOIN o
        ON o.class = CASE WHEN prob1 > u THEN 1 WHEN prob1 + prob2 > u THEN 2 ELSE 3 END""",
)
def _(d: Data) -> DataFrame:
    probs = ["prob1", "prob2", "prob3"]
    order, _ = bounded(po.class_order(d.posteriors_long()).select(F.col("class").alias("pseudo"), "class_ord"))
    drawn = po.pseudo_class_draws(d.posteriors().select("id", "cohort", *probs), "id", probs, 60, seed=7)
    return drawn.join(order, "pseudo").select("imp", "cohort", "id", "class_ord")


# ---- results -----------------------------------------------------------------------------------------------------


@query(
    "mdl_result_table",
    f"""WITH {_OLS} SELECT cohort, 'BMI @ age ' || CASE WHEN age < 14 THEN 11 WHEN age < 18 THEN 16 ELSE age END AS test_clean, 'Rank' AS cog_clean,
        printf('%.2f (%.2f, %.2f)', beta, beta - {sm.Z!r} * se, beta + {sm.Z!r} * se) AS string FROM ols WHERE age IN (10, 15, 40)""",
)
def _(d: Data) -> DataFrame:
    fits = rg.simple_ols(ranked_long(d, "cog_rank"), "bmi", "cog_rank", ["cohort", "age"])
    named = fits.withColumn("name", F.concat(F.lit("cog_rank_bmi_"), F.col("age").cast("string")))
    parts = F.split("name", "_")
    fup = parts[3].cast("int")
    band = F.when(fup < 14, 11).when(fup < 18, 16).otherwise(fup).cast("string")
    b, half = F.col("beta"), normal.Z975 * F.col("se")
    return named.filter(fup.isin(10, 15, 40)).select(
        "cohort", F.concat(F.upper(parts[2]), F.lit(" @ age "), band).alias("test_clean"),
        lookup(parts[1], {"rank": "Rank", "std": "Z-Score"}).alias("cog_clean"), estimate_text(b, b - half, b + half).alias("string"),
    )


@query(
    "mdl_odds_ratio",
    f"""WITH {_POOL_FITS}, {sm.rubin('p', 'fits', 'cohort, term')} SELECT cohort, term, {q6('exp(beta)')} AS beta, {q6(f'exp(beta - {sm.Z!r} * se)')} AS lci,
        {q6(f'exp(beta + {sm.Z!r} * se)')} AS uci FROM p WHERE term <> '(Intercept)'""",
)
def _(d: Data) -> DataFrame:
    pooled = inf.pool_normal(imputed_fits(d), ["cohort", "term"])
    return rounded(inf.odds_ratios(pooled, "term", "^[a-z]"), ["cohort", "term"], {"beta": 6, "lci": 6, "uci": 6})


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "mdl_interaction_terms",
    "SELECT id, " + ", ".join(f"CAST(cohort = '{s}' AS DOUBLE) AS cohort{s}" for s in _SEG[1:]) + ", cog, "
    + ", ".join(f"CAST(cohort = '{s}' AS DOUBLE) * cog AS \"cohort{s}:cog\"" for s in _SEG[1:]) + ", CAST(male AS DOUBLE) AS male, "
    + ", ".join(f"CAST(father_class = {k} AS DOUBLE) AS father_class{k}" for k in CLASSES[1:]) + " FROM members",
)
def _(d: Data) -> DataFrame:
    frame, _ = design(d.members(), ["cohort*cog", "male", "father_class"], {"cohort": _SEG, "father_class": CLASSES}, ["id"])
    return frame
