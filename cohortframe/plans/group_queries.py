"""Queries on aggregates and windows."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortframe.functions.clean import ordinal
from cohortframe.operators import aggregate as ag
from cohortframe.operators import ranks as rk
from cohortframe.operators import samples as sm
from cohortframe.operators.reshape import long_to_wide, wide_to_long
from cohortframe.plans.fixtures import ADULT_BMI, BMI, Data, q6, r6
from cohortframe.plans.registry import query
from cohortframe.session import bounded

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CLASSES = [1, 2, 3, 4, 5, 6]


# ---- aggregates --------------------------------------------------------------------------------------------------


# bmi has six decimals, so its sums are whole numbers of millionths and the spread is the same however rows are grouped
EXACT_SD = """CASE WHEN count(bmi) > 1 THEN sqrt(CAST(count(bmi) * sum(CAST(round(bmi * 1e6) AS HUGEINT) * CAST(round(bmi * 1e6) AS HUGEINT))
  - sum(CAST(round(bmi * 1e6) AS HUGEINT)) * sum(CAST(round(bmi * 1e6) AS HUGEINT)) AS DOUBLE) / (CAST(count(bmi) AS DOUBLE) * (count(bmi) - 1))) / 1e6 END"""


def exact_sd(column: str) -> Column:
    n, whole = F.count(column), F.round(F.col(column) * 1e6).cast("decimal(17,0)")
    total = F.sum(whole).cast("decimal(19,0)")
    spread = n.cast("decimal(12,0)") * F.sum((whole * whole).cast("decimal(24,0)")).cast("decimal(26,0)") - total * total
    return F.when(n > 1, F.sqrt(spread.cast("double") / (n.cast("double") * (n - 1))) / 1e6)


@query(
    "agg_basic",
    f"""SELECT cohort, age, count(*) AS n, {q6('sum(bmi)')} AS total, {q6('avg(bmi)')} AS mean, {q6(EXACT_SD)} AS sd,
               min(bmi) AS lo, max(bmi) AS hi FROM bmi_long GROUP BY 1, 2""",
)
def _(d: Data) -> DataFrame:
    return d.bmi_long().groupBy("cohort", "age").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("bmi")).alias("total"), r6(F.avg("bmi")).alias("mean"),
        r6(exact_sd("bmi")).alias("sd"), F.min("bmi").alias("lo"), F.max("bmi").alias("hi"),
    )


@query(
    "agg_weighted_count",
    """SELECT cohort, father_class, sum(survey_weight) AS n, CAST(sum(CAST(cog IS NULL AS INTEGER)) AS BIGINT) AS n_miss
       FROM members GROUP BY 1, 2""",
)
def _(d: Data) -> DataFrame:
    return d.members().groupBy("cohort", "father_class").agg(
        F.sum("survey_weight").alias("n"), F.sum(F.col("cog").isNull().cast("int")).alias("n_miss")
    )


_PROFILED = ["bmi_10", "bmi_40", "cog"]


@query(
    "agg_profile",
    " UNION ALL ".join(
        f"""SELECT cohort, '{v}' AS variable, count({v}) AS n, {q6(f'100 * CAST(count(*) - count({v}) AS DOUBLE) / count(*)')} AS missing,
        {q6(f'avg({v})')} AS mean, {q6(f'stddev_samp({v})')} AS sd, min({v}) AS min, max({v}) AS max,
        {q6(f'stddev_samp({v}) / avg({v})')} AS cv FROM members_wide GROUP BY cohort""" for v in _PROFILED),
)
def _(d: Data) -> DataFrame:
    p = ag.profile(d.members_wide(), ["cohort"], _PROFILED)
    return p.select(
        "cohort", "variable", "n", r6("missing").alias("missing"), r6("mean").alias("mean"), r6("sd").alias("sd"), "min",
        "max", r6("cv").alias("cv"),
    )


_COUNTED = ["cog", "father_class", "mother_edu_level", *BMI]


@query(
    "agg_missing_count",
    " UNION ALL ".join(f"SELECT '{v}' AS variable, count(*) - count({v}) AS n_missing FROM members_wide" for v in _COUNTED),
)
def _(d: Data) -> DataFrame:
    return ag.missing_counts(d.members_wide(), _COUNTED)


@query("agg_distinct", "SELECT event_type, CAST(day(ts) AS INTEGER) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def _(d: Data) -> DataFrame:
    seen = d.table("events", "event_type", "ts", "user_id").select("event_type", F.dayofmonth("ts").alias("day"), "user_id").distinct()
    return seen.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("users"))


@query(
    "agg_distinct_keep_first",
    """SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
       ORDER BY ts, event_id) k FROM events) WHERE k = 1""",
)
def _(d: Data) -> DataFrame:
    e = d.table("events", "user_id", "event_type", "ts", "event_id", "value")
    return sm.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "agg_crosstab_with_missing",
    """SELECT father_class, count(*) FILTER (WHERE mother_edu_level = 0) AS n_0, count(*) FILTER (WHERE mother_edu_level = 1) AS n_1,
              count(*) FILTER (WHERE mother_edu_level IS NULL) AS n_missing FROM members GROUP BY 1""",
)
def _(d: Data) -> DataFrame:
    return ag.crosstab(d.members(), "father_class", "mother_edu_level", [0, 1])


_T1_NUM = ["cog", "bmi_40"]
_T1_CAT = {"male": [0, 1], "father_class": CLASSES, "mother_edu_level": [0, 1]}


def _table_one_sql() -> str:
    def block(source: str, weight: str, tag: str) -> list[str]:
        rows = [f"SELECT cohort, 'n' AS variable, 'n' AS level, CAST(count(*) AS DOUBLE) AS v, NULL AS miss, '{tag}' AS tag FROM {source} GROUP BY cohort"]
        for c in _T1_NUM:
            rows.append(
                f"""SELECT cohort, '{c}', '{c}', sum({weight} * {c}) / sum(CASE WHEN {c} IS NOT NULL THEN {weight} END),
                100 * CAST(count(*) - count({c}) AS DOUBLE) / count(*), '{tag}' FROM {source} GROUP BY cohort""")
        for c, levels in _T1_CAT.items():
            for level in levels:
                rows.append(
                    f"""SELECT cohort, '{c}', '{level}', 100 * coalesce(sum({weight}) FILTER (WHERE {c} = {level}), 0)
                    / sum({weight}) FILTER (WHERE {c} IS NOT NULL), 100 * CAST(count(*) - count({c}) AS DOUBLE) / count(*), '{tag}'
                    FROM {source} GROUP BY cohort""")
        return rows

    both = block("cc_rows", "CAST(1 AS DOUBLE)", "cc") + block("mi_rows", "survey_weight", "mi")
    wide = ", ".join(
        f"{q6(f'''max(v) FILTER (WHERE tag = 'cc' AND cohort = '{s}')''')} AS cc_{s}, "
        f"{q6(f'''max(miss) FILTER (WHERE tag = 'cc' AND cohort = '{s}')''')} AS miss_{s}, "
        f"{q6(f'''max(v) FILTER (WHERE tag = 'mi' AND cohort = '{s}')''')} AS mi_{s}" for s in SEGMENTS)
    return f"""WITH cc_rows AS (SELECT * FROM imputed WHERE imp = 0), mi_rows AS (SELECT * FROM imputed WHERE imp > 0),
               t AS ({' UNION ALL '.join(both)}) SELECT variable, level, {wide} FROM t GROUP BY variable, level"""


@query("agg_table_one", _table_one_sql())
def _(d: Data) -> DataFrame:
    stack = d.imputed()
    value = F.coalesce(F.col("pct"), F.col("mean"), F.col("n").cast("double")).alias("v")
    cc = ag.table_one(stack.filter("imp = 0"), "cohort", _T1_NUM, _T1_CAT).select("cohort", "variable", "level", value, "missing")
    mi = ag.table_one(stack.filter("imp > 0"), "cohort", _T1_NUM, _T1_CAT, "survey_weight").select("cohort", "variable", "level", value)
    rows = cc.withColumnsRenamed({"v": "cc", "missing": "miss"}).join(mi.withColumnRenamed("v", "mi"), ["cohort", "variable", "level"])
    wide = long_to_wide(rows, ["variable", "level"], "cohort", {"cc": "cc", "miss": "miss", "mi": "mi"}, SEGMENTS)
    return wide.select("variable", "level", *[r6(c).alias(c) for c in wide.columns[2:]])


_ITEMS = ["maths_11", "verbal_11", "reading_11", "nonverbal_11"]


def _corr_sql(source: str, tag: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{tag}' AS kept, '{a}' AS x, '{b}' AS y, {q6(f'corr({a}, {b})')} AS r FROM {source}"
        for i, a in enumerate(_ITEMS) for b in _ITEMS[i + 1:])


@query(
    "agg_corr_matrix",
    "WITH full_rows AS (SELECT * FROM items WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in _ITEMS) + ") "
    + _corr_sql("items", "pairwise") + " UNION ALL " + _corr_sql("full_rows", "complete"),
)
def _(d: Data) -> DataFrame:
    items = d.items()
    both = [
        ag.corr_matrix(items, _ITEMS, pairwise=pairwise).withColumn("kept", F.lit(tag))
        for tag, pairwise in (("pairwise", True), ("complete", False))
    ]
    return both[0].unionByName(both[1]).select("kept", "x", "y", r6("r").alias("r"))


SPEARMAN_PAIRS = [("cog", "bmi_40"), ("bmi_10", "bmi_40"), ("father_class", "cog")]


def _spearman_sql(a: str, b: str) -> str:
    return f"""SELECT cohort, '{a}' AS x, '{b}' AS y, count(*) AS n, {q6('corr(rx, ry)')} AS rho FROM (SELECT cohort,
      rank() OVER (PARTITION BY cohort ORDER BY {a}) + (count(*) OVER (PARTITION BY cohort, {a}) - 1) / CAST(2 AS DOUBLE) AS rx,
      rank() OVER (PARTITION BY cohort ORDER BY {b}) + (count(*) OVER (PARTITION BY cohort, {b}) - 1) / CAST(2 AS DOUBLE) AS ry
      FROM members_wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY cohort"""


SPEARMAN_SQL = " UNION ALL ".join(_spearman_sql(a, b) for a, b in SPEARMAN_PAIRS)


@query("agg_spearman", SPEARMAN_SQL)
def _(d: Data) -> DataFrame:
    return ag.spearman(d.members_wide(), SPEARMAN_PAIRS, ["cohort"]).select("cohort", "x", "y", "n", r6("rho").alias("rho"))


_TRI = ["bmi_10", "bmi_15", "bmi_20", "cog"]
# Display levels in order (fixed values).
_TRI_LEVELS = ["Cognition", "BMI @ Age 11", "BMI @ Age 16"]
_TRI_CLEAN = {"cog": "Cognition", "bmi_10": "BMI @ Age 11", "bmi_15": "BMI @ Age 16", "bmi_20": "BMI @ Age 16"}


def _tri_sql() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT cohort, '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM members_wide GROUP BY cohort"
        for a, b in permutations(_TRI, 2))
    clean = lambda v: "CASE " + " ".join(f"WHEN {v} = '{k}' THEN '{c}'" for k, c in _TRI_CLEAN.items()) + " END"
    level = lambda v: "CASE " + " ".join(f"WHEN {v} = '{c}' THEN {i}" for i, c in enumerate(_TRI_LEVELS, 1)) + " END"
    return f"""WITH p AS ({pairs}), c AS (SELECT *, {clean('x')} AS x_clean, {clean('y')} AS y_clean FROM p),
      k AS (SELECT *, row_number() OVER (PARTITION BY cohort, x_clean, y_clean ORDER BY x, y) AS k FROM c)
      SELECT cohort, x_clean, y_clean, x, y, {q6('r')} AS r FROM k WHERE k = 1 AND {level('x_clean')} < {level('y_clean')}"""


@query("agg_pair_triangle", _tri_sql())
def _(d: Data) -> DataFrame:
    r = ag.corr_matrix(d.members_wide(), _TRI, ["cohort"])
    both = r.unionByName(r.select("cohort", F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    pairs = [item for k, v in _TRI_CLEAN.items() for item in (F.lit(k), F.lit(v))]
    table = F.create_map(*pairs)
    named = both.withColumns({"x_clean": table[F.col("x")], "y_clean": table[F.col("y")]})
    first = sm.first_per_key(named, ["cohort", "x_clean", "y_clean"], ["x", "y"])
    kept = first.filter(ordinal(F.col("x_clean"), _TRI_LEVELS) < ordinal(F.col("y_clean"), _TRI_LEVELS))
    return kept.select("cohort", "x_clean", "y_clean", "x", "y", r6("r").alias("r"))


@query(
    "agg_quantile",
    f"""SELECT cohort, age, {q6('quantile_cont(bmi, 0.025)')} AS lo, {q6('quantile_cont(bmi, 0.5)')} AS mid,
               {q6('quantile_cont(bmi, 0.975)')} AS hi FROM bmi_long GROUP BY 1, 2""",
)
def _(d: Data) -> DataFrame:
    q = rk.group_quantiles(d.bmi_long(), "bmi", ["cohort", "age"], [0.025, 0.5, 0.975])
    return q.select("cohort", "age", *[r6(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


@query(
    "agg_collect_list",
    """SELECT id, count(*) AS n, string_agg(CAST(age AS VARCHAR), ',' ORDER BY age) AS ages, arg_min(bmi, age) AS first_bmi,
              arg_max(bmi, age) AS last_bmi FROM waves GROUP BY id""",
)
def _(d: Data) -> DataFrame:
    packed = d.waves().groupBy("id").agg(F.sort_array(F.collect_list(F.struct("age", "bmi"))).alias("data"))
    return packed.select(
        "id", F.size("data").cast("long").alias("n"),
        F.array_join(F.transform("data", lambda w: w["age"].cast("string")), ",").alias("ages"),
        F.element_at("data", 1)["bmi"].alias("first_bmi"), F.element_at("data", -1)["bmi"].alias("last_bmi"),
    )


@query(
    "agg_string",
    """WITH a AS (SELECT cohort, male, father_class, count(*) AS n FROM members WHERE father_class IS NOT NULL GROUP BY 1, 2, 3),
            b AS (SELECT cohort, male, string_agg(CAST(n AS VARCHAR) || ' in class ' || CAST(father_class AS VARCHAR), ' and ' ORDER BY father_class) AS s
                  FROM a GROUP BY 1, 2)
       SELECT cohort, string_agg(s || ' (' || CAST(male AS VARCHAR) || ')', ', ' ORDER BY male) AS string FROM b GROUP BY 1""",
)
def _(d: Data) -> DataFrame:
    cells = d.members().dropna(subset=["father_class"]).groupBy("cohort", "male", "father_class").agg(F.count(F.lit(1)).alias("n"))
    piece = F.concat(F.col("n").cast("string"), F.lit(" in class "), F.col("father_class").cast("string"))
    joined = lambda key, text, sep: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(key, text))), lambda x: x["col2"]), sep)
    inner = cells.groupBy("cohort", "male").agg(joined(F.col("father_class"), piece.alias("col2"), " and ").alias("s"))
    outer = F.concat("s", F.lit(" ("), F.col("male").cast("string"), F.lit(")"))
    return inner.groupBy("cohort").agg(joined(F.col("male"), outer.alias("col2"), ", ").alias("string"))


@query(
    "agg_group_diff",
    f"""WITH g AS (SELECT cohort, age, male, avg(bmi) AS bmi FROM bmi_long GROUP BY 1, 2, 3)
        SELECT cohort, age, {q6('arg_max(bmi, male) - arg_min(bmi, male)')} AS diff FROM g GROUP BY 1, 2""",
)
def _(d: Data) -> DataFrame:
    g = d.bmi_long().groupBy("cohort", "age", "male").agg(F.avg("bmi").alias("bmi"))
    return g.groupBy("cohort", "age").agg(r6(F.max_by("bmi", "male") - F.min_by("bmi", "male")).alias("diff"))


@query(
    "agg_share_of_total",
    f"""SELECT cohort, father_class, count(*) AS n, {q6('count(*) / CAST(sum(count(*)) OVER (PARTITION BY cohort) AS DOUBLE)')} AS share
        FROM members GROUP BY 1, 2""",
)
def _(d: Data) -> DataFrame:
    s = ag.share_of_total(d.members(), ["cohort", "father_class"], ["cohort"])
    return s.withColumn("share", r6("share"))


@query(
    "agg_linear_score",
    f"""WITH coef AS (SELECT cohort, age, avg(bmi) AS beta FROM bmi_long GROUP BY 1, 2)
        SELECT w.cohort, w.id, {q6('sum(c.beta * w.bmi / 100)')} AS score FROM bmi_long w JOIN coef c ON w.cohort = c.cohort AND w.age = c.age
        GROUP BY 1, 2""",
)
def _(d: Data) -> DataFrame:
    long = d.bmi_long().select("cohort", "id", "age", "bmi")
    coef, _ = bounded(long.groupBy("cohort", "age").agg(F.avg("bmi").alias("beta")))
    return long.join(coef, ["cohort", "age"]).groupBy("cohort", "id").agg(
        r6(F.sum(F.col("beta") * F.col("bmi") / 100)).alias("score")
    )


_POINTS = 512


@query(
    "agg_kde",
    f"""WITH x AS (SELECT cohort, age, bmi FROM bmi_long),
      s AS (SELECT cohort, age, count(*) AS n, min(bmi) AS lo, max(bmi) AS hi, 0.9 * least(stddev_samp(bmi),
            (quantile_cont(bmi, 0.75) - quantile_cont(bmi, 0.25)) / CAST(1.34 AS DOUBLE)) * pow(count(*), CAST(-0.2 AS DOUBLE)) AS bw FROM x GROUP BY 1, 2),
      g AS (SELECT *, lo - 3 * bw AS start, (hi - lo + 6 * bw) / {_POINTS - 1} AS step FROM s),
      r AS (SELECT x.cohort, x.age, (bmi - start) / step AS place FROM x JOIN g ON x.cohort = g.cohort AND x.age = g.age),
      b AS (SELECT cohort, age, cell, sum(mass) AS mass FROM (
            SELECT cohort, age, floor(place) AS cell, 1 - (place - floor(place)) AS mass FROM r
            UNION ALL SELECT cohort, age, floor(place) + 1, place - floor(place) FROM r) GROUP BY 1, 2, 3)
      SELECT b.cohort, b.age, CAST(p AS INTEGER) AS point, {q6('max(start + p * step)')} AS x,
        {q6(f'sum(mass * exp(-pow((p - cell) * step / bw, 2) / 2) / (sqrt(2 * pi()) * bw) / n)')} AS density
      FROM b JOIN g ON b.cohort = g.cohort AND b.age = g.age, (SELECT unnest(range(0, {_POINTS})) AS p) GROUP BY 1, 2, 3""",
)
def _(d: Data) -> DataFrame:
    k = ag.kernel_density(d.bmi_long(), "bmi", ["cohort", "age"], _POINTS)
    return k.select("cohort", "age", "point", r6("x").alias("x"), r6("density").alias("density"))


# ---- windows -----------------------------------------------------------------------------------------------------

_RANKED = """SELECT id, cohort, cog, rank() OVER (PARTITION BY cohort, cog IS NULL ORDER BY cog) AS rk,
  dense_rank() OVER (PARTITION BY cohort, cog IS NULL ORDER BY cog) AS dk, count(*) OVER (PARTITION BY cohort, cog) AS ties,
  count(cog) OVER (PARTITION BY cohort) AS n FROM members"""


@query("win_percent_rank", f"SELECT id, cohort, CASE WHEN cog IS NOT NULL THEN {q6('CAST(rk - 1 AS DOUBLE) / NULLIF(n - 1, 0)')} END AS cog_rank FROM ({_RANKED})")
def _(d: Data) -> DataFrame:
    s = rk.add_scores(d.members().select("id", "cohort", "cog"), "cog", ["cohort"], {"rank": "cog_rank"})
    return s.select("id", "cohort", r6("cog_rank").alias("cog_rank"))


@query("win_dense_rank", f"SELECT id, cohort, CASE WHEN cog IS NOT NULL THEN dk END AS cog_dense FROM ({_RANKED})")
def _(d: Data) -> DataFrame:
    s = rk.add_scores(d.members().select("id", "cohort", "cog"), "cog", ["cohort"], {"dense": "cog_dense"})
    return s.select("id", "cohort", F.col("cog_dense").cast("long").alias("cog_dense"))


@query("win_ridit", f"SELECT id, cohort, CASE WHEN cog IS NOT NULL THEN {q6('(rk - 1 + CAST(0.5 AS DOUBLE) * ties) / n')} END AS cog_ridit FROM ({_RANKED})")
def _(d: Data) -> DataFrame:
    s = rk.add_scores(d.members().select("id", "cohort", "cog"), "cog", ["cohort"], {"ridit": "cog_ridit"})
    return s.select("id", "cohort", r6("cog_ridit").alias("cog_ridit"))


@query(
    "win_zscore",
    f"""SELECT id, age, {q6('(bmi - avg(bmi) OVER w) / stddev_samp(bmi) OVER w')} AS z FROM bmi_long
        WINDOW w AS (PARTITION BY cohort, age)""",
)
def _(d: Data) -> DataFrame:
    return rk.add_zscore(d.bmi_long(), "bmi", ["cohort", "age"], "z").select("id", "age", r6("z").alias("z"))


@query(
    "win_zscore_weighted",
    f"""WITH m AS (SELECT *, sum(survey_weight * cog) OVER w / sum(CASE WHEN cog IS NOT NULL THEN survey_weight END) OVER w AS mu,
                sum(CASE WHEN cog IS NOT NULL THEN survey_weight END) OVER w AS sw FROM members WINDOW w AS (PARTITION BY cohort, male))
        SELECT id, {q6('(cog - mu) / sqrt(sum(survey_weight * pow(cog - mu, 2)) OVER (PARTITION BY cohort, male) / (sw - 1))')} AS z FROM m""",
)
def _(d: Data) -> DataFrame:
    z = rk.add_zscore(d.members(), "cog", ["cohort", "male"], "z", "survey_weight")
    return z.select("id", r6("z").alias("z"))


@query(
    "win_score_bundle",
    f"""WITH s AS (SELECT 'all' AS sex, imp, cohort, id, cog FROM imputed WHERE male IS NOT NULL UNION ALL
                  SELECT CASE WHEN male = 1 THEN 'male' ELSE 'female' END, imp, cohort, id, cog FROM imputed WHERE male IS NOT NULL),
      r AS (SELECT *, rank() OVER (PARTITION BY sex, imp, cohort, cog IS NULL ORDER BY cog) AS rk, count(*) OVER (PARTITION BY sex, imp, cohort, cog) AS ties,
            count(cog) OVER g AS n, avg(cog) OVER g AS mu, stddev_samp(cog) OVER g AS sd FROM s WINDOW g AS (PARTITION BY sex, imp, cohort))
      SELECT sex, imp, r.cohort, id, cog AS cog_raw, {q6('(cog - mu) / sd')} AS cog_std, CASE WHEN cog IS NOT NULL THEN {q6('CAST(rk - 1 AS DOUBLE) / (n - 1)')} END AS cog_rank,
        CASE WHEN cog IS NOT NULL THEN {q6('(rk - 1 + CAST(0.5 AS DOUBLE) * ties) / n')} END AS cog_ridit
      FROM r WHERE id IN (SELECT id FROM members_wide WHERE {' AND '.join(b + ' IS NOT NULL' for b in ADULT_BMI)})""",
)
def _(d: Data) -> DataFrame:
    stack = d.imputed().select("imp", "cohort", "id", "cog", "male").where("male IS NOT NULL")
    own = F.when(F.col("male") == 1, "male").otherwise("female")
    strata = stack.withColumn("sex", F.explode(F.array(F.lit("all"), own)))
    kinds = {"raw": "cog_raw", "std": "cog_std", "rank": "cog_rank", "ridit": "cog_ridit"}
    scored = rk.add_scores(strata, "cog", ["sex", "imp", "cohort"], kinds)
    balanced = d.wave_columns().dropna(subset=ADULT_BMI).select("id")
    kept = scored.join(balanced, "id", "left_semi")
    return kept.select("sex", "imp", "cohort", "id", "cog_raw", *[r6(k).alias(k) for k in ("cog_std", "cog_rank", "cog_ridit")])


@query("win_lead", "SELECT id, age, bmi, lead(bmi) OVER (PARTITION BY id ORDER BY age) AS next_bmi FROM waves")
def _(d: Data) -> DataFrame:
    nxt = F.lead("bmi").over(Window.partitionBy("id").orderBy("age"))
    return d.waves().select("id", "age", "bmi", nxt.alias("next_bmi"))


_FUPS = """per_id AS (SELECT cohort, id, count(*) AS fups FROM bmi_long GROUP BY 1, 2),
  per_k AS (SELECT cohort, fups, count(*) AS n FROM per_id GROUP BY 1, 2),
  shares AS (SELECT *, 100 * n / CAST(sum(n) OVER (PARTITION BY cohort) AS DOUBLE) AS prop FROM per_k),
  kept AS (SELECT *, 100 - coalesce(sum(prop) OVER (PARTITION BY cohort ORDER BY fups ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_prop FROM shares)"""


@query("win_lag_cumsum", f"WITH {_FUPS} SELECT cohort, CAST(fups AS INTEGER) AS fups, {q6('cum_prop')} AS cum_prop FROM kept")
def _(d: Data) -> DataFrame:
    per_id = d.bmi_long().groupBy("cohort", "id").agg(F.count(F.lit(1)).cast("int").alias("fups"))
    shares = ag.share_of_total(per_id, ["cohort", "fups"], ["cohort"])
    w = Window.partitionBy("cohort").orderBy("fups")
    running = F.sum(100 * F.col("share")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    summed = shares.withColumn("running", running)
    kept = F.when(F.row_number().over(w) == 1, F.lit(100.0)).otherwise(100 - F.lag("running").over(w))
    return summed.withColumn("cum_prop", kept).select("cohort", "fups", r6("cum_prop").alias("cum_prop"))


@query("win_row_number", "SELECT id, age, CAST(row_number() OVER (PARTITION BY id ORDER BY age) AS INTEGER) AS visit FROM waves")
def _(d: Data) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("id").orderBy("age"))
    return d.waves().select("id", "age", k.alias("visit"))


@query("win_group_id", "SELECT cohort, id, dense_rank() OVER (ORDER BY cohort, id) AS gmm_id FROM (SELECT DISTINCT cohort, id FROM bmi_long)")
def _(d: Data) -> DataFrame:
    return rk.group_ids(d.bmi_long(), ["cohort", "id"], "gmm_id")


@query("win_group_count", "SELECT id, age, count(*) OVER (PARTITION BY id) AS fups, sum(survey_weight) OVER (PARTITION BY id) AS weight FROM bmi_long")
def _(d: Data) -> DataFrame:
    per_id = Window.partitionBy("id")
    return d.bmi_long().select(
        "id", "age", F.count(F.lit(1)).over(per_id).alias("fups"), F.sum("survey_weight").over(per_id).alias("weight")
    )


@query(
    "win_group_flag",
    """SELECT imp, id, CAST(max(CAST(cog IS NULL AND imp = 0 AS INTEGER)) OVER (PARTITION BY id) AS INTEGER) AS miss FROM imputed""",
)
def _(d: Data) -> DataFrame:
    gap = (F.col("cog").isNull() & (F.col("imp") == 0)).cast("int")
    return d.imputed().select("imp", "id", F.max(gap).over(Window.partitionBy("id")).alias("miss"))


@query("win_normalised_weight", f"SELECT id, {q6('(0.3 + survey_weight) * count(*) OVER () / sum(0.3 + survey_weight) OVER ()')} AS w FROM members")
def _(d: Data) -> DataFrame:
    m = d.members().select("id", (0.3 + F.col("survey_weight")).alias("inf"))
    return sm.normalised_weight(m, "inf", "w").select("id", r6("w").alias("w"))


@query(
    "win_dropout_wave",
    """WITH g AS (SELECT i.cohort, i.id, a.age, w.bmi FROM (SELECT DISTINCT cohort, id FROM bmi_long WHERE age >= 20) i
              JOIN (SELECT DISTINCT cohort, age FROM bmi_long WHERE age >= 20) a ON i.cohort = a.cohort LEFT JOIN waves w ON i.id = w.id AND a.age = w.age),
            l AS (SELECT *, lead(bmi) OVER (PARTITION BY cohort, id ORDER BY age) AS nxt FROM g)
       SELECT cohort, id, min(age) AS last_age FROM l WHERE bmi IS NOT NULL AND nxt IS NULL GROUP BY 1, 2""",
)
def _(d: Data) -> DataFrame:
    return sm.dropout_wave(d.bmi_long().filter(F.col("age") >= 20), "cohort", "id", "age", "bmi")


@query(
    "win_retention_table",
    f"WITH {_FUPS} SELECT cohort, " + ", ".join(
        q6(f"max(cum_prop) FILTER (WHERE fups = {k})") + f" AS waves_{k}" for k in range(1, 8)) + " FROM kept GROUP BY cohort",
)
def _(d: Data) -> DataFrame:
    r = sm.retention(d.bmi_long(), "cohort", "id", 7)
    return r.select("cohort", *[r6(f"waves_{k}").alias(f"waves_{k}") for k in range(1, 8)])
