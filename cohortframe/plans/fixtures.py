"""Cohort-shaped views of the test tables, as DataFrames and as SQL text.

``customer`` plays the members, ``orders`` the repeated waves, ``lineitem`` the test items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.operators.joins import attach_stats
from cohortframe.operators.reshape import wide_to_long
from cohortframe.session import bounded
from cohortframe.sources.tables import scan

AGES = [10, 15, 20, 25, 30, 35, 40]
FIRST_YEAR = 1993
BMI = [f"bmi_{a}" for a in AGES]
ADULT_BMI = [f"bmi_{a}" for a in AGES if a >= 20]
NUMERIC_FILL = [*BMI, "cog", "birth_weight"]
IMPUTATIONS = 4


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines; no negative zero."""
    value = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def q6(expression: str, digits: int = 6) -> str:
    return f"(CASE WHEN round({expression}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({expression}, {digits}) END)"


def exact_mean(total: Column, count: Column, scale: int, divisor: int, digits: int) -> Column:
    """total * scale / (count * divisor) rounded half up in whole numbers, then moved ``digits`` places."""
    bottom = count * divisor
    top = total * (2 * scale) + bottom
    whole = F.when(count > 0, (top - F.pmod(top, bottom * 2)) / (bottom * 2))
    return whole / float(10**digits)


def exact_mean_sql(total: str, count: str, scale: int, divisor: int, digits: int) -> str:
    top = f"CAST({total} * {2 * scale} + {count} * {divisor} AS BIGINT)"
    return f"CAST({top} // NULLIF({count} * {2 * divisor}, 0) AS DOUBLE) / CAST({10**digits} AS DOUBLE)"


class Data:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str, *columns: str, where: Column | None = None) -> DataFrame:
        return scan(self.spark, f"{self.folder}/{name}.parquet", list(columns) or None, where)

    def members(self) -> DataFrame:
        c = self.table("customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        return c.select(
            key.alias("id"),
            F.col("c_mktsegment").alias("cohort"),
            (key % 2).cast("int").alias("male"),
            (0.5 + (key % 4) / 2.0).cast("double").alias("survey_weight"),
            F.when(key % 11 != 0, 1 + nation % 6).cast("int").alias("father_class"),
            F.when(key % 13 != 0, nation % 2).cast("int").alias("mother_edu_level"),
            F.when(key % 17 != 0, F.col("c_acctbal")).alias("cog"),
            (1 + key % 3).cast("int").alias("raw_sex"),
            (nation - 2).cast("int").alias("raw_class"),
        )

    def wave_columns(self) -> DataFrame:
        """One row per member with orders: bmi and self-report per age, from one aggregate on the member key."""
        o = self.table("orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
        year = F.year("o_orderdate")
        columns = []
        for age in AGES:
            here = year == FIRST_YEAR + age // 5
            cents = F.sum(F.when(here, F.round(F.col("o_totalprice") * 100).cast("long")))
            columns.append(exact_mean(cents, F.count_if(here), 1, 1, 6).alias(f"bmi_{age}"))
            # the leading digit as a number keeps the aggregate on the hash path
            top = F.max(F.when(here, F.substring("o_orderpriority", 1, 1).cast("int")))
            columns.append(F.when(top < 4, 1).when(top.isNotNull(), 2).cast("int").alias(f"self_report_{age}"))
        return o.groupBy(F.col("o_custkey").alias("id")).agg(*columns)

    def waves(self) -> DataFrame:
        wide = self.wave_columns()
        rows = F.array(*[
            F.struct(F.lit(a).alias("age"), F.col(f"bmi_{a}").alias("bmi"), F.col(f"self_report_{a}").alias("self_report"))
            for a in AGES
        ])
        long = wide.select("id", F.explode(rows).alias("w")).select("id", "w.*")
        return long.filter(F.col("bmi").isNotNull())

    def members_wide(self, *extra: str) -> DataFrame:
        return self.members().join(self.wave_columns().select("id", *BMI, *extra), "id", "left")

    def bmi_long(self) -> DataFrame:
        wide = self.members().select("id", "cohort", "male", "survey_weight", "cog").join(self.wave_columns(), "id")
        rows = F.array(*[
            F.struct(F.lit(a).alias("age"), F.col(f"bmi_{a}").alias("bmi"), F.col(f"self_report_{a}").alias("self_report"))
            for a in AGES
        ])
        long = wide.select("cohort", "id", "male", "survey_weight", "cog", F.explode(rows).alias("w"))
        return long.select("cohort", "id", "male", "survey_weight", "cog", "w.*").filter(F.col("bmi").isNotNull())

    def items(self) -> DataFrame:
        li = self.table("lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
        o = self.table("orders", "o_orderkey", "o_custkey")
        n = F.count(F.lit(1))
        grouped = (
            li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("id"))
            .agg(
                exact_mean(F.sum(F.col("l_quantity").cast("long")), n, 10**6, 1, 6).alias("m"),
                exact_mean(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")), n, 100, 1, 4).alias("v"),
                n.alias("reading_11"),
                exact_mean(F.sum(F.round(F.col("l_discount") * 100).cast("long")), n, 10**4, 1, 6).alias("nonverbal_11"),
                (10.5 + exact_mean(F.sum(F.col("l_linenumber").cast("long")), n, 10**6, 7, 6)).alias("a"),
                (1 + F.min("l_quantity") / 20).alias("birth_weight"),
            )
        )
        return grouped.select(
            "id",
            F.when(F.col("id") % 19 != 0, F.col("m")).alias("maths_11"),
            F.when(F.col("id") % 23 != 0, F.col("v")).alias("verbal_11"),
            "reading_11",
            "nonverbal_11",
            F.when(F.col("id") % 29 != 0, F.col("a")).alias("age_11"),
            "birth_weight",
        )

    def study(self) -> DataFrame:
        """Members with waves and birth weight: one wide row per member."""
        base = self.members_wide().join(self.items().select("id", "birth_weight"), "id", "left")
        return base.select(
            "id", "cohort", "male", "survey_weight", "father_class", "mother_edu_level", "birth_weight", "cog", *BMI
        )

    def imputed(self, m: int = IMPUTATIONS) -> DataFrame:
        """Observed rows (imp 0) and m completed copies filled by a fixed rule.

        ``missing_waves`` lists the adult waves without an observed value, the same on every copy of a member.
        """
        study = self.study()
        stats, _ = bounded(
            study.groupBy("cohort").agg(
                *[F.round(F.avg(c), 6).alias(f"m_{c}") for c in NUMERIC_FILL],
                *[F.round(F.stddev_samp(c), 6).alias(f"s_{c}") for c in NUMERIC_FILL],
            )
        )
        rows = attach_stats(study, stats, ["cohort"]).withColumn("imp", F.explode(F.sequence(F.lit(0), F.lit(m))))
        key = F.col("id") * 7919 + F.col("imp") * 104729
        shift = (key % 2001) / 1000.0 - 1
        first = F.col("imp") == 0

        def fill(c: str) -> Column:
            if c == "father_class":
                value = (1 + key % 6).cast("int")
            elif c == "mother_edu_level":
                value = (key % 2).cast("int")
            else:
                value = F.col(f"m_{c}") + F.col(f"s_{c}") * shift
            return F.when(first, F.col(c)).otherwise(F.coalesce(F.col(c), value)).alias(c)

        return rows.select(
            "imp", "id", "cohort", "male", "survey_weight", fill("father_class"), fill("mother_edu_level"),
            *[fill(c) for c in ("birth_weight", "cog", *BMI)],
            F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ADULT_BMI])).alias("missing_waves"),
        )

    def posteriors(self) -> DataFrame:
        """Class probabilities per member, wide, with the most likely class."""
        a, b, c = (1 + F.col("id") % k for k in (5, 7, 11))
        total = a + b + c
        p = self.members().select("id", "cohort", (a / total).alias("prob1"), (b / total).alias("prob2"), (c / total).alias("prob3"))
        best = F.greatest("prob1", "prob2", "prob3")
        return p.withColumn(
            "class", F.when(F.col("prob1") == best, 1).when(F.col("prob2") == best, 2).otherwise(3).cast("int")
        )

    def posteriors_long(self) -> DataFrame:
        return wide_to_long(self.posteriors(), ["id", "cohort", "class"], "^prob", "name", "value")

    def growth_reference(self) -> DataFrame:
        rows = self.spark.range(0, 18).select(
            (F.col("id") % 2).cast("int").alias("sex"), (5.0 * (1 + F.floor(F.col("id") / 2))).alias("age")
        )
        age, sex = F.col("age"), F.col("sex")
        return rows.select(
            "sex", "age", (-1 + age / 50).alias("l"), (15 + age / 4 + sex).alias("m"), (0.1 + age / 1000).alias("s")
        )


def _filled(c: str) -> str:
    key = "(w.id * 7919 + k.imp * 104729)"
    if c == "father_class":
        value = f"CAST(1 + {key} % 6 AS INTEGER)"
    elif c == "mother_edu_level":
        value = f"CAST({key} % 2 AS INTEGER)"
    else:
        value = f"s.m_{c} + s.s_{c} * (CAST({key} % 2001 AS DOUBLE) / 1000 - 1)"
    return f"CASE WHEN k.imp = 0 THEN w.{c} ELSE coalesce(w.{c}, {value}) END AS {c}"


CENTS = "sum(CAST(round(o_totalprice * 100) AS BIGINT))"


def wave_sql(age: int) -> str:
    year = f"year(o_orderdate) = {FIRST_YEAR + age // 5}"
    return (
        f"{exact_mean_sql(f'{CENTS} FILTER (WHERE {year})', f'count(*) FILTER (WHERE {year})', 1, 1, 6)} AS bmi_{age}, "
        f"CAST(CASE WHEN max(o_orderpriority) FILTER (WHERE {year}) < '4' THEN 1 "
        f"WHEN max(o_orderpriority) FILTER (WHERE {year}) IS NOT NULL THEN 2 END AS INTEGER) AS self_report_{age}"
    )


def imputed_sql(m: int) -> str:
    return f"""
SELECT CAST(k.imp AS INTEGER) AS imp, w.id, w.cohort, w.male, w.survey_weight,
       {", ".join(_filled(c) for c in ("father_class", "mother_edu_level", "birth_weight", "cog", *BMI))}
FROM study w CROSS JOIN (SELECT unnest(range(0, {m + 1})) AS imp) k JOIN study_stats s ON w.cohort = s.cohort"""


# View name -> SQL; a view may use views above it.
SQL_VIEWS: dict[str, str] = {
    "members": """
SELECT c_custkey AS id, c_mktsegment AS cohort, CAST(c_custkey % 2 AS INTEGER) AS male,
       CAST(0.5 + (c_custkey % 4) / 2.0 AS DOUBLE) AS survey_weight,
       CAST(CASE WHEN c_custkey % 11 <> 0 THEN 1 + c_nationkey % 6 END AS INTEGER) AS father_class,
       CAST(CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey % 2 END AS INTEGER) AS mother_edu_level,
       CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS cog,
       CAST(1 + c_custkey % 3 AS INTEGER) AS raw_sex, CAST(c_nationkey - 2 AS INTEGER) AS raw_class
FROM customer""",
    "waves": f"""
SELECT o_custkey AS id, CAST((year(o_orderdate) - 1993) * 5 AS INTEGER) AS age,
       {exact_mean_sql(CENTS, 'count(*)', 1, 1, 6)} AS bmi,
       CAST(CASE WHEN max(o_orderpriority) < '4' THEN 1 ELSE 2 END AS INTEGER) AS self_report
FROM orders GROUP BY 1, 2""",
    "wave_columns": f"SELECT o_custkey AS id, {', '.join(wave_sql(a) for a in AGES)} FROM orders GROUP BY 1",
    "members_wide": f"SELECT m.*, {', '.join('w.' + c for c in BMI)} FROM members m LEFT JOIN wave_columns w ON m.id = w.id",
    "bmi_long": """
SELECT m.cohort, w.id, m.male, m.survey_weight, m.cog, w.age, w.bmi, w.self_report
FROM waves w JOIN members m ON w.id = m.id""",
    "items": f"""
SELECT id, CASE WHEN id % 19 <> 0 THEN mm END AS maths_11, CASE WHEN id % 23 <> 0 THEN vv END AS verbal_11,
       reading_11, nonverbal_11, CASE WHEN id % 29 <> 0 THEN aa END AS age_11, birth_weight
FROM (SELECT o_custkey AS id, {exact_mean_sql('sum(CAST(l_quantity AS BIGINT))', 'count(*)', 10**6, 1, 6)} AS mm,
             {exact_mean_sql('sum(CAST(round(l_extendedprice * 100) AS BIGINT))', 'count(*)', 100, 1, 4)} AS vv,
             count(*) AS reading_11,
             {exact_mean_sql('sum(CAST(round(l_discount * 100) AS BIGINT))', 'count(*)', 10**4, 1, 6)} AS nonverbal_11,
             10.5 + {exact_mean_sql('sum(l_linenumber)', 'count(*)', 10**6, 7, 6)} AS aa, 1 + min(l_quantity) / 20 AS birth_weight
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)""",
    "study": f"""
SELECT m.id, m.cohort, m.male, m.survey_weight, m.father_class, m.mother_edu_level, i.birth_weight, m.cog,
       {', '.join('m.' + c for c in BMI)}
FROM members_wide m LEFT JOIN items i ON m.id = i.id""",
    "study_stats": f"""
SELECT cohort, {', '.join(f'round(avg({c}), 6) AS m_{c}, round(stddev_samp({c}), 6) AS s_{c}' for c in NUMERIC_FILL)}
FROM study GROUP BY cohort""",
    "imputed": imputed_sql(IMPUTATIONS),
    "posteriors": """
SELECT *, CAST(CASE WHEN prob1 = greatest(prob1, prob2, prob3) THEN 1
                    WHEN prob2 = greatest(prob1, prob2, prob3) THEN 2 ELSE 3 END AS INTEGER) AS class
FROM (SELECT id, cohort, CAST(a AS DOUBLE) / (a + b + c) AS prob1, CAST(b AS DOUBLE) / (a + b + c) AS prob2,
             CAST(c AS DOUBLE) / (a + b + c) AS prob3
      FROM (SELECT id, cohort, 1 + id % 5 AS a, 1 + id % 7 AS b, 1 + id % 11 AS c FROM members))""",
    "posteriors_long": """
SELECT id, cohort, class, 'prob1' AS name, prob1 AS value FROM posteriors
UNION ALL SELECT id, cohort, class, 'prob2', prob2 FROM posteriors
UNION ALL SELECT id, cohort, class, 'prob3', prob3 FROM posteriors""",
    "growth_reference": """
SELECT sex, age, -1 + age / 50 AS l, 15 + age / 4 + sex AS m, CAST(0.1 AS DOUBLE) + age / 1000 AS s
FROM (SELECT CAST(sx AS INTEGER) AS sex, CAST(5 * ag AS DOUBLE) AS age
      FROM (SELECT unnest(range(0, 2)) AS sx) CROSS JOIN (SELECT unnest(range(1, 10)) AS ag))""",
}
