"""Queries on scans, projections, scalar functions, filters, joins, reshape and sets."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortframe.functions import clean as c
from cohortframe.functions import normal as nd
from cohortframe.functions import text as t
from cohortframe.functions.draws import hash_uniform_sql
from cohortframe.operators import joins as j
from cohortframe.operators import reshape as rs
from cohortframe.operators import samples as sm
from cohortframe.operators import select as sel
from cohortframe.operators.inequality import inequality_join
from cohortframe.plans.fixtures import ADULT_BMI, AGES, BMI, Data, q6, r6
from cohortframe.plans.registry import query
from cohortframe.operators.posteriors import class_order
from cohortframe.session import bounded, shared_folder, stage
from cohortframe.sources.tables import cohort_union, decode_labels, decode_labels_from, load_table, save_table

# Label text of the social class codes (fixed values).
CLASS_LABELS = {
    1: "V Unskilled",
    2: "IV Partly Skilled",
    3: "III Skilled Manual",
    4: "III Skilled Non-Manual",
    5: "II Intermediate",
    6: "I Professional",
}
CLASS_SQL = "CASE father_class " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CLASS_LABELS.items()) + " END"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


# ---- scans -------------------------------------------------------------------------------------------------------


@query("src_pruned_scan", "SELECT o_custkey AS id, o_orderdate, o_totalprice FROM orders")
def _(d: Data) -> DataFrame:
    return d.table("orders", "o_custkey", "o_orderdate", "o_totalprice").withColumnRenamed("o_custkey", "id")


@query("src_filtered_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND c_acctbal > 0")
def _(d: Data) -> DataFrame:
    ok = F.col("c_acctbal").isNotNull() & (F.col("c_acctbal") > 0)
    return d.table("customer", "c_custkey", "c_acctbal", where=ok)


@query(
    "src_cohort_union_scan",
    """SELECT id, cohort, cog, father_class, CASE WHEN cohort IN ('AUTOMOBILE', 'BUILDING') THEN mother_edu_level END
              AS mother_edu_level FROM members""",
)
def _(d: Data) -> DataFrame:
    m = d.members()
    tables = {}
    for cohort in SEGMENTS:
        names = ["id", "cog", "father_class"]
        if cohort in ("AUTOMOBILE", "BUILDING"):
            names.append("mother_edu_level")
        tables[cohort] = m.filter(F.col("cohort") == cohort).select(*names)
    return cohort_union(tables).select("id", "cohort", "cog", "father_class", "mother_edu_level")


@query(
    "src_decode_labels",
    f"""SELECT m.id, {CLASS_SQL} AS father_class, n_name AS nation FROM members m
        JOIN customer ON m.id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(d: Data) -> DataFrame:
    nations = d.table("nation", "n_nationkey", "n_name")
    m = d.members().join(d.table("customer", "c_custkey", "c_nationkey"), F.col("id") == F.col("c_custkey"))
    named = decode_labels_from(m, "c_nationkey", nations, "n_nationkey", "n_name", "nation")
    return decode_labels(named.select("id", "father_class", "nation"), "father_class", CLASS_LABELS, "father_class")


# ---- projections -------------------------------------------------------------------------------------------------


@query("prj_select_pattern", "SELECT id, cohort, bmi_10, bmi_15, father_class FROM members_wide")
def _(d: Data) -> DataFrame:
    return sel.select_pattern(
        d.members_wide(), keep=r"^bmi_", drop=r"_[2-9].$", first=("id", "cohort"), any_of=("father_class", "absent")
    )


@query(
    "prj_rename_pattern",
    "SELECT id, bmi_10 AS mass_10, bmi_15 AS mass_15, bmi_20 AS mass_20, male AS sex FROM members_wide",
)
def _(d: Data) -> DataFrame:
    df = sel.rename_pattern(d.members_wide(), r"^bmi_", "mass_").withColumnRenamed("male", "sex")
    return df.select("id", "mass_10", "mass_15", "mass_20", "sex")


@query(
    "prj_across",
    f"""SELECT id, bmi_10 AS bmi_10_raw, {q6('ln(bmi_10)')} AS bmi_10_log, bmi_20 AS bmi_20_raw,
               {q6('ln(bmi_20)')} AS bmi_20_log FROM wave_columns""",
)
def _(d: Data) -> DataFrame:
    rules = {"raw": lambda x: x, "log": lambda x: r6(F.log(x))}
    df = sel.across(d.wave_columns(), ["bmi_10", "bmi_20"], rules)
    return df.select("id", "bmi_10_raw", "bmi_10_log", "bmi_20_raw", "bmi_20_log")


@query("prj_derive_if", "SELECT id, CASE WHEN raw_sex BETWEEN 1 AND 2 THEN 2 - raw_sex END AS male FROM members")
def _(d: Data) -> DataFrame:
    sex = F.col("raw_sex")
    return d.members().select("id", c.derive_if(2 - sex, sex.between(1, 2)).alias("male"))


@query(
    "prj_replace_if",
    """SELECT id, age, CASE WHEN self_report IS DISTINCT FROM 1 THEN NULL ELSE bmi END AS bmi_measured,
              CAST(CASE WHEN bmi > 30 THEN 1 ELSE self_report END AS INTEGER) AS self_report FROM waves""",
)
def _(d: Data) -> DataFrame:
    w = d.waves()
    return w.select(
        "id", "age",
        c.replace_if(F.col("bmi"), F.lit(None).cast("double"), c.not_equal(F.col("self_report"), 1)).alias("bmi_measured"),
        c.replace_if(F.col("self_report"), F.lit(1), F.col("bmi") > 30).alias("self_report"),
    )


@query(
    "prj_sentinel_to_null",
    """SELECT id, CASE WHEN raw_class NOT IN (9, 22) AND raw_class >= 0 THEN raw_class END AS father_class
       FROM members""",
)
def _(d: Data) -> DataFrame:
    return d.members().select("id", c.null_codes(F.col("raw_class"), (9, 22), below=0).alias("father_class"))


@query(
    "prj_range_to_null",
    """SELECT id, age, CASE WHEN bmi > 13 AND bmi < 40 THEN bmi END AS bmi_open,
              CASE WHEN bmi BETWEEN 13 AND 40 THEN bmi END AS bmi_closed FROM waves""",
)
def _(d: Data) -> DataFrame:
    bmi = F.col("bmi")
    return d.waves().select(
        "id", "age", c.null_outside(bmi, 13, 40, "open").alias("bmi_open"), c.null_outside(bmi, 13, 40).alias("bmi_closed")
    )


@query(
    "prj_in_range_flag",
    """SELECT id, CASE WHEN coalesce(raw_class, 0) BETWEEN 0 AND 20
                       THEN CAST(coalesce(father_class BETWEEN 4 AND 6, FALSE) AS INTEGER) END AS high FROM members""",
)
def _(d: Data) -> DataFrame:
    flag = c.in_range(F.col("father_class"), 4, 6)
    return d.members().select("id", F.when(c.in_range(F.col("raw_class"), 0, 20) == 1, flag).alias("high"))


@query(
    "prj_recode_map",
    """SELECT id, CAST(CASE raw_class WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2
              WHEN 5 THEN 1 END AS INTEGER) AS father_class FROM members""",
)
def _(d: Data) -> DataFrame:
    codes = {0: 6, 1: 5, 2: 4, 3: 3, 4: 2, 5: 1, 21: None, 22: None}
    return d.members().select("id", c.recode(F.col("raw_class"), codes).alias("father_class"))


@query(
    "prj_reverse_code",
    """SELECT id, CASE WHEN raw_sex BETWEEN 1 AND 2 THEN 2 - raw_sex END AS male,
              CASE WHEN raw_class BETWEEN 1 AND 6 THEN 7 - raw_class END AS father_class FROM members""",
)
def _(d: Data) -> DataFrame:
    return d.members().select(
        "id", c.reverse_code(F.col("raw_sex"), 2, 1, 2).alias("male"),
        c.reverse_code(F.col("raw_class"), 7, 1, 6).alias("father_class"),
    )


@query(
    "prj_shift_cap",
    """SELECT id, CASE WHEN raw_class BETWEEN 1 AND 10 THEN raw_class - 0 WHEN raw_class BETWEEN 11 AND 20 THEN 10 END
       AS edu_years FROM members""",
)
def _(d: Data) -> DataFrame:
    return d.members().select("id", c.shift_cap(F.col("raw_class"), 0, 1, 10, 10, 20).alias("edu_years"))


@query(
    "prj_unit_convert",
    f"""SELECT l_orderkey, l_linenumber, l_quantity, {q6('l_quantity * CAST(2.54 AS DOUBLE) / 100')} AS metres,
               {q6('l_quantity * CAST(0.0283495 AS DOUBLE)')} AS kg_oz,
               {q6('(l_quantity * 14 + l_linenumber) * CAST(0.454 AS DOUBLE)')} AS kg_stone,
               {q6('(l_linenumber * 12 + l_quantity) * CAST(2.54 AS DOUBLE)')} AS cm FROM lineitem""",
)
def _(d: Data) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return d.table("lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        r6(c.inches_to_m(q)).alias("metres"), r6(c.ounces_to_kg(q)).alias("kg_oz"),
        r6(c.stones_pounds_to_kg(q, n)).alias("kg_stone"), r6(c.feet_inches_to_cm(n, q)).alias("cm"),
    )


_WEIGHT = "(40 + p_size)"
_HEIGHT = "(p_retailprice / 10)"


@query(
    "prj_bmi",
    f"""SELECT p_partkey AS id, {q6(f'{_WEIGHT} / (({_HEIGHT} / 100) * ({_HEIGHT} / 100))')} AS bmi_11,
               CASE WHEN p_size - 1 <> 0 THEN {q6(f'{_WEIGHT} / pow(CAST(p_size - 1 AS DOUBLE) / 100, 2)', 4)} END AS bmi_16
        FROM part""",
)
def _(d: Data) -> DataFrame:
    p = d.table("part", "p_partkey", "p_size", "p_retailprice")
    weight = 40 + F.col("p_size")
    heights = {"bmi_11": (F.col("p_retailprice") / 10, 6), "bmi_16": ((F.col("p_size") - 1).cast("double"), 4)}
    return p.select(
        F.col("p_partkey").alias("id"), *[r6(c.bmi(weight, h), k).alias(n) for n, (h, k) in heights.items()]
    )


_Y2 = "(year(o_orderdate) - 1900)"


@query(
    "prj_age_from_months",
    f"""SELECT o_orderkey, {q6(f'(({_Y2} * 12 + month(o_orderdate)) - (46 * 12 + 3)) / CAST(12 AS DOUBLE)')} AS age
        FROM orders""",
)
def _(d: Data) -> DataFrame:
    month, year = F.month("o_orderdate"), F.year("o_orderdate") - 1900
    birth = c.month_index(F.lit(3), F.lit(46))
    return d.table("orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", r6(c.age_from_months(month, year, birth)).alias("age")
    )


@query(
    "prj_century_pivot",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) % 100 < 46 THEN 54 + year(o_orderdate) % 100
                               ELSE year(o_orderdate) % 100 - 46 END AS age FROM orders""",
)
def _(d: Data) -> DataFrame:
    year2 = F.year("o_orderdate") % 100
    return d.table("orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", c.age_from_year2(year2).cast("long").alias("age")
    )


@query(
    "prj_zero_pad",
    """SELECT event_id, lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS month2,
              'bmi_' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS name FROM events""",
)
def _(d: Data) -> DataFrame:
    return d.table("events", "event_id", "ts").select(
        "event_id", c.zero_pad(F.month("ts")).alias("month2"),
        F.concat(F.lit("bmi_"), c.zero_pad(F.col("event_id") % 60)).alias("name"),
    )


@query(
    "prj_rowwise_max",
    """SELECT id, greatest(bmi_10, bmi_15, bmi_20) AS bmi_max,
              greatest(self_report_10, self_report_15) AS self_report FROM wave_columns""",
)
def _(d: Data) -> DataFrame:
    return d.wave_columns().select(
        "id", c.row_max(*[F.col(f"bmi_{a}") for a in (10, 15, 20)]).alias("bmi_max"),
        c.row_max(F.col("self_report_10"), F.col("self_report_15")).alias("self_report"),
    )


@query("prj_first_valid", "SELECT id, coalesce(bmi_40, bmi_35, bmi_30, bmi_25) AS last_bmi FROM wave_columns")
def _(d: Data) -> DataFrame:
    return d.wave_columns().select("id", c.first_valid(*[F.col(f"bmi_{a}") for a in (40, 35, 30, 25)]).alias("last_bmi"))


@query(
    "prj_provenance_flag",
    """SELECT id, CASE WHEN bmi_40 IS NOT NULL THEN 1 WHEN bmi_35 IS NOT NULL THEN 2 END AS source,
              CASE WHEN self_report_40 IS DISTINCT FROM 1 AND bmi_40 IS NOT NULL THEN 2 ELSE self_report_40 END
              AS self_report FROM wave_columns""",
)
def _(d: Data) -> DataFrame:
    flag = F.col("self_report_40")
    return d.wave_columns().select(
        "id", c.provenance(F.col("bmi_40"), F.col("bmi_35")).alias("source"),
        c.replace_if(flag, F.lit(2), c.not_equal(flag, 1) & F.col("bmi_40").isNotNull()).alias("self_report"),
    )


@query(
    "prj_drop_constant_cols",
    "SELECT id, bmi_10, CAST(CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS self_b, CAST(NULL AS INTEGER) AS self_c FROM members_wide",
)
def _(d: Data) -> DataFrame:
    df = d.members_wide().select(
        "id", "bmi_10", F.when(F.col("id") % 3 == 0, 1).alias("self_a"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("self_b"), F.lit(None).cast("int").alias("self_c"),
    )
    return sel.drop_constant(df, "^self_")


@query(
    "prj_case_when",
    """SELECT id, age, CASE WHEN bmi < 18.5 THEN 'under' WHEN bmi < 25 THEN 'healthy' WHEN bmi < 30 THEN 'over'
              ELSE 'obese' END AS band FROM waves""",
)
def _(d: Data) -> DataFrame:
    bmi = F.col("bmi")
    band = F.when(bmi < 18.5, "under").when(bmi < 25, "healthy").when(bmi < 30, "over").otherwise("obese")
    return d.waves().select("id", "age", band.alias("band"))


_NAMES = {"click": "Visit", "view": "Interview", "purchase": "Test", "signup": "Birth"}


@query(
    "prj_dict_lookup",
    "SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items())
    + " END AS label FROM events",
)
def _(d: Data) -> DataFrame:
    return d.table("events", "event_id", "event_type").select("event_id", c.lookup(F.col("event_type"), _NAMES).alias("label"))


_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


@query(
    "prj_ordinal_factor",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3
              WHEN '2-HIGH' THEN 4 END AS level, CASE o_orderpriority WHEN '5-LOW' THEN 4 WHEN '4-NOT SPECIFIED' THEN 3
              WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 1 END AS reversed,
              o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') AS below_medium
       FROM orders WHERE o_orderpriority <> '1-URGENT'""",
)
def _(d: Data) -> DataFrame:
    p = F.col("o_orderpriority")
    o = d.table("orders", "o_orderkey", "o_orderpriority", where=p != "1-URGENT")
    medium = _ORDER.index("3-MEDIUM") + 1
    return o.select(
        "o_orderkey", c.ordinal(p, _ORDER).alias("level"), c.ordinal(p, _ORDER[::-1]).alias("reversed"),
        (c.ordinal(p, _ORDER) < medium).alias("below_medium"),
    )


@query("prj_missing_flag", "SELECT id, CAST(cog IS NULL AS INTEGER) AS cog_miss, CAST(bmi_30 IS NULL AS INTEGER) AS bmi_miss FROM members_wide")
def _(d: Data) -> DataFrame:
    return d.members_wide().select(
        "id", c.missing_flag(F.col("cog")).alias("cog_miss"), c.missing_flag(F.col("bmi_30")).alias("bmi_miss")
    )


# ---- scalar functions --------------------------------------------------------------------------------------------


@query(
    "fn_substr_signed",
    """SELECT c_custkey, right(c_name, 2) AS last2, left(c_name, 4) AS first4,
              CASE WHEN strpos(c_name, '#') > 0 THEN left(c_name, strpos(c_name, '#') - 1) ELSE c_name END AS stub FROM customer""",
)
def _(d: Data) -> DataFrame:
    name = F.col("c_name")
    return d.table("customer", "c_custkey", "c_name").select(
        "c_custkey", t.signed_substring(name, -2).alias("last2"), t.signed_substring(name, 1, 4).alias("first4"),
        t.before_first(name, "#").alias("stub"),
    )


@query("fn_regex_match", "SELECT p_partkey, p_name, regexp_matches(p_brand, '[1-3]$') AS low_brand FROM part WHERE regexp_matches(p_name, '^(small|red) ')")
def _(d: Data) -> DataFrame:
    return d.table("part", "p_partkey", "p_name", "p_brand").filter(F.col("p_name").rlike("^(small|red) ")).select(
        "p_partkey", "p_name", F.col("p_brand").rlike("[1-3]$").alias("low_brand")
    )


@query("fn_regex_replace", "SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS plain, replace(source, '.', '') AS source FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents", "doc_id", "text", "source").select(
        "doc_id", t.strip_punctuation(F.col("text")).alias("plain"), F.replace("source", F.lit("."), F.lit("")).alias("source")
    )


@query("fn_case_convert", "SELECT p_partkey, upper(p_name) AS up, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title FROM part")
def _(d: Data) -> DataFrame:
    return d.table("part", "p_partkey", "p_name", "p_type").select(
        "p_partkey", F.upper("p_name").alias("up"), F.initcap("p_type").alias("title")
    )


@query(
    "fn_interpolate",
    """SELECT id, age, printf('%.2f (%.2f, %.2f)', bmi, bmi - 1, bmi + 1) AS string,
              'bmi_' || CAST(age AS VARCHAR) || ' @ Age ' || CAST(age AS VARCHAR) AS label FROM waves""",
)
def _(d: Data) -> DataFrame:
    b, age = F.col("bmi"), F.col("age").cast("string")
    return d.waves().select(
        "id", "age", t.estimate_text(b, b - 1, b + 1).alias("string"),
        F.concat(F.lit("bmi_"), age, F.lit(" @ Age "), age).alias("label"),
    )


@query(
    "fn_number_format",
    """SELECT doc_id, format('{:,}', n_chars) AS big, printf('%.1f', CAST(n_chars AS DOUBLE) / 7) || '%' AS pct FROM documents""",
)
def _(d: Data) -> DataFrame:
    n = F.col("n_chars")
    return d.table("documents", "doc_id", "n_chars").select(
        "doc_id", t.thousands(n).alias("big"), t.percent(n / 7).alias("pct")
    )


@query(
    "fn_split_unite",
    """SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS level, split_part(o_orderpriority, '-', 2) AS word,
              split_part(o_orderpriority, '-', 2) || '_' || o_orderstatus AS united FROM orders""",
)
def _(d: Data) -> DataFrame:
    parts = F.split("o_orderpriority", "-")
    return d.table("orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(
        "o_orderkey", parts[0].cast("int").alias("level"), parts[1].alias("word"),
        F.concat_ws("_", parts[1], F.col("o_orderstatus")).alias("united"),
    )


@query("fn_str_length", "SELECT doc_id, length(text) AS n, length(lang) = 2 AS short_lang FROM documents")
def _(d: Data) -> DataFrame:
    return d.table("documents", "doc_id", "text", "lang").select(
        "doc_id", F.length("text").cast("long").alias("n"), (F.length("lang") == 2).alias("short_lang")
    )


@query(
    "fn_round_half_even",
    "SELECT event_id, round_even(CAST(event_id AS DOUBLE) / 8, 2) AS eighth, round_even(CAST(event_id AS DOUBLE) / 2, 0) AS half FROM events",
)
def _(d: Data) -> DataFrame:
    k = F.col("event_id").cast("double")
    return d.table("events", "event_id").select(
        "event_id", F.bround(k / 8, 2).alias("eighth"), F.bround(k / 2, 0).alias("half")
    )


@query(
    "fn_math",
    f"""SELECT id, age, {q6('exp(bmi / 20)')} AS e, {q6('ln(bmi)')} AS l, {q6('sqrt(bmi)')} AS s,
               {q6('abs(bmi - 15)')} AS a, {q6('pow(bmi, 0.3)')} AS p FROM waves""",
)
def _(d: Data) -> DataFrame:
    b = F.col("bmi")
    return d.waves().select(
        "id", "age", r6(F.exp(b / 20)).alias("e"), r6(F.log(b)).alias("l"), r6(F.sqrt(b)).alias("s"),
        r6(F.abs(b - 15)).alias("a"), r6(F.pow(b, F.lit(0.3))).alias("p"),
    )


@query(
    "fn_normal_cdf",
    f"SELECT id, z, {q6(nd.cdf_sql('z'), 8)} AS p FROM (SELECT id, (cog - 4500) / 1100 AS z FROM members)",
)
def _(d: Data) -> DataFrame:
    z = d.members().select("id", ((F.col("cog") - 4500) / 1100).alias("z"))
    return z.select("id", "z", r6(nd.normal_cdf(F.col("z")), 8).alias("p"))


@query(
    "fn_normal_quantile",
    f"""SELECT id, p, {q6(nd.quantile_sql('p'), 8)} AS z
        FROM (SELECT id, (1 + CAST(id * 7919 % 100003 AS DOUBLE)) / 100005 AS p FROM members)""",
)
def _(d: Data) -> DataFrame:
    p = d.members().select("id", ((1 + (F.col("id") * 7919 % 100003).cast("double")) / 100005).alias("p"))
    return p.select("id", "p", r6(nd.normal_quantile(F.col("p")), 8).alias("z"))


# ---- filters -----------------------------------------------------------------------------------------------------


@query("flt_predicate", "SELECT id, cohort, male FROM members WHERE (raw_class BETWEEN 1 AND 12) AND (raw_sex = 1 OR father_class = 1)")
def _(d: Data) -> DataFrame:
    keep = F.col("raw_class").between(1, 12) & ((F.col("raw_sex") == 1) | (F.col("father_class") == 1))
    return d.members().filter(keep).select("id", "cohort", "male")


@query("flt_drop_null", "SELECT id, cohort, cog, father_class FROM members WHERE cog IS NOT NULL AND father_class IS NOT NULL AND mother_edu_level IS NOT NULL")
def _(d: Data) -> DataFrame:
    return d.members().dropna(subset=["cog", "father_class", "mother_edu_level"]).select("id", "cohort", "cog", "father_class")


@query("flt_in_list", "SELECT id, cohort FROM members WHERE cohort IN ('BUILDING', 'HOUSEHOLD') AND (father_class NOT IN (1, 6))")
def _(d: Data) -> DataFrame:
    return d.members().filter(F.col("cohort").isin("BUILDING", "HOUSEHOLD") & ~F.col("father_class").isin(1, 6)).select("id", "cohort")


@query("flt_in_table", "SELECT id, age, bmi FROM waves WHERE id IN (SELECT id FROM members WHERE male = 1 AND cog > 5000)")
def _(d: Data) -> DataFrame:
    some = d.members().filter((F.col("male") == 1) & (F.col("cog") > 5000)).select("id")
    return d.waves().select("id", "age", "bmi").join(some, "id", "left_semi")


@query(
    "flt_null_by_membership",
    """SELECT m.id, CASE WHEN w.id IS NULL THEN m.cog END AS cog FROM members m
       LEFT JOIN (SELECT DISTINCT id FROM waves WHERE bmi > 45) w ON m.id = w.id""",
)
def _(d: Data) -> DataFrame:
    high = d.waves().filter(F.col("bmi") > 45)
    marked = j.flag_membership(d.members().select("id", "cog"), high, ["id"], "high")
    return marked.select("id", F.when(F.col("high") == 0, F.col("cog")).alias("cog"))


@query(
    "flt_group_extreme",
    """SELECT cohort, id, age, bmi FROM (SELECT *, min(age) OVER (PARTITION BY cohort) lo, max(age) OVER (PARTITION BY cohort) hi
       FROM bmi_long) WHERE age = lo OR age = hi""",
)
def _(d: Data) -> DataFrame:
    return sm.group_extreme(d.bmi_long(), ["cohort"], "age").select("cohort", "id", "age", "bmi")


@query(
    "flt_group_any_nonzero",
    """WITH x AS (SELECT id, age, CASE WHEN bmi > 30 THEN round(bmi - 30, 6) ELSE 0 END AS excess FROM waves)
       SELECT id, age, excess FROM (SELECT *, max(abs(excess)) OVER (PARTITION BY id) top FROM x) WHERE top <> 0""",
)
def _(d: Data) -> DataFrame:
    x = d.waves().select("id", "age", F.when(F.col("bmi") > 30, F.round(F.col("bmi") - 30, 6)).otherwise(0.0).alias("excess"))
    top = F.max(F.abs("excess")).over(Window.partitionBy("id"))
    return x.withColumn("top", top).filter(F.col("top") != 0).drop("top")


@query(
    "flt_min_observations",
    "SELECT cohort, id, age, bmi FROM bmi_long WHERE id IN (SELECT id FROM waves GROUP BY id HAVING count(*) >= 4)",
)
def _(d: Data) -> DataFrame:
    return sm.min_observations(d.bmi_long().select("cohort", "id", "age", "bmi"), ["id"], 4)


@query(
    "flt_row_by_number",
    "SELECT id, age, bmi FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY age) k FROM waves) WHERE k = 2",
)
def _(d: Data) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("id").orderBy("age"))
    return d.waves().select("id", "age", "bmi", k.alias("k")).filter(F.col("k") == 2).drop("k")


# ---- joins -------------------------------------------------------------------------------------------------------

_MERGE_RIGHT = "(SELECT doc_id + 20 AS doc_id, quality, toxic, CAST(toxic * 100 AS BIGINT) AS n_chars FROM labels)"


@query(
    "join_merge_1to1",
    f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.lang, CASE WHEN a.doc_id IS NOT NULL THEN a.n_chars ELSE b.n_chars END AS n_chars,
               b.quality, b.toxic, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 3 WHEN a.doc_id IS NOT NULL THEN 1 ELSE 2 END AS merged
        FROM (SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n_chars FROM documents) a
        FULL JOIN {_MERGE_RIGHT} b ON a.doc_id = b.doc_id""",
)
def _(d: Data) -> DataFrame:
    left = d.table("documents", "doc_id", "lang", "n_chars").withColumn(
        "n_chars", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars"))
    )
    right = d.table("labels").select(
        (F.col("doc_id") + 20).alias("doc_id"), "quality", "toxic", (F.col("toxic") * 100).cast("long").alias("n_chars")
    )
    return j.merge_one_to_one(left, right, ["doc_id"], "merged")


@query(
    "join_merge_mto1",
    """SELECT c_custkey, coalesce(n_nationkey, c_nationkey) AS nationkey, n_name, r_name,
              CASE WHEN c_custkey IS NOT NULL AND n_nationkey IS NOT NULL THEN 3 WHEN c_custkey IS NOT NULL THEN 1 ELSE 2 END AS merged
       FROM customer FULL JOIN (SELECT * FROM nation LEFT JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey""",
)
def _(d: Data) -> DataFrame:
    customers = d.table("customer", "c_custkey", "c_nationkey").withColumnRenamed("c_nationkey", "nationkey")
    nations = d.table("nation").withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"})
    regions = d.table("region").withColumnRenamed("r_regionkey", "regionkey")
    named = nations.join(regions, "regionkey", "left").select("nationkey", "n_name", "r_name")
    return j.merge_many_to_one(customers, named, ["nationkey"], "merged").select(
        "c_custkey", "nationkey", "n_name", "r_name", "merged"
    )


@query(
    "join_composite_key",
    """WITH a AS (SELECT o_custkey AS fam, CAST(1 + month(o_orderdate) % 2 AS INTEGER) AS num_a, max(o_totalprice) AS va
                  FROM orders WHERE year(o_orderdate) <= 1996 GROUP BY 1, 2),
            b AS (SELECT o_custkey AS fam, CAST(1 + month(o_orderdate) % 2 AS INTEGER) AS num_b, max(o_totalprice) AS vb
                  FROM orders WHERE year(o_orderdate) IN (1997, 1998) GROUP BY 1, 2),
            ab AS (SELECT coalesce(a.fam, b.fam) AS fam, coalesce(num_a, num_b) AS num, va, vb FROM a FULL JOIN b ON a.fam = b.fam AND num_a = num_b),
            e AS (SELECT o_custkey AS fam, CAST(1 + month(o_orderdate) % 2 AS INTEGER) AS num_e, max(o_totalprice) AS ve
                  FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY 1, 2)
       SELECT coalesce(ab.fam, e.fam) AS fam, coalesce(num, num_e) AS num, va, vb, ve FROM ab FULL JOIN e ON ab.fam = e.fam AND num = num_e""",
)
def _(d: Data) -> DataFrame:
    orders = d.table("orders", "o_custkey", "o_orderdate", "o_totalprice")

    def sweep(first: int, last: int, number: str, value: str) -> DataFrame:
        """One of three sweeps, each of some years; together they hold all orders."""
        child = (1 + F.month("o_orderdate") % 2).cast("int")
        return orders.filter(F.year("o_orderdate").between(first, last)).groupBy(F.col("o_custkey").alias("fam"), child.alias(number)).agg(
            F.max("o_totalprice").alias(value)
        )

    # the child number has its own name in each sweep: repair it by first valid, then merge on (family, number)
    sweeps = [sweep(0, 1996, "num_a", "va"), sweep(1997, 1998, "num_b", "vb"), sweep(1999, 9999, "num_e", "ve")]
    numbered = [
        s.withColumn("num", c.first_valid(F.col(n))).drop(n) for s, n in zip(sweeps, ("num_a", "num_b", "num_e"))
    ]
    return j.full_reduce(numbered, ["fam", "num"]).select("fam", "num", "va", "vb", "ve")


@query(
    "join_full_reduce",
    f"""SELECT id, {', '.join(f'max(bmi) FILTER (WHERE age = {a}) AS b{a}' for a in range(10, 41, 5))} FROM waves GROUP BY id""",
)
def _(d: Data) -> DataFrame:
    w = d.waves()
    parts = [w.filter(F.col("age") == a).select("id", F.col("bmi").alias(f"b{a}")) for a in range(10, 41, 5)]
    return j.full_reduce(parts, ["id"])


@query("join_left", "SELECT w.id, w.age, w.bmi, m.cohort, m.male FROM waves w LEFT JOIN members m ON w.id = m.id AND m.cog IS NOT NULL")
def _(d: Data) -> DataFrame:
    m = d.members().filter(F.col("cog").isNotNull()).select("id", "cohort", "male")
    return d.waves().select("id", "age", "bmi").join(m, "id", "left")


@query(
    "join_right",
    """SELECT p.id, p.class, m.cog FROM (SELECT id, 1 + male AS class, cog FROM members) m
       RIGHT JOIN posteriors p ON m.id = p.id AND m.class = p.class""",
)
def _(d: Data) -> DataFrame:
    m = d.members().select("id", (1 + F.col("male")).alias("class"), "cog")
    return m.join(d.posteriors().select("id", "class"), ["id", "class"], "right")


@query(
    "join_inner_chain",
    """SELECT m.id, m.cohort, m.cog, w.bmi, i.maths_11 FROM members m JOIN waves w ON m.id = w.id AND w.age = 30
       JOIN items i ON m.id = i.id JOIN (SELECT DISTINCT id FROM waves WHERE age = 40) p ON m.id = p.id
       WHERE m.cog IS NOT NULL""",
)
def _(d: Data) -> DataFrame:
    wide = d.wave_columns().filter(F.col("bmi_40").isNotNull() & F.col("bmi_30").isNotNull())
    m = d.members().filter(F.col("cog").isNotNull()).select("id", "cohort", "cog")
    joined = m.join(wide.select("id", F.col("bmi_30").alias("bmi")), "id").join(d.items().select("id", "maths_11"), "id")
    return joined.select("id", "cohort", "cog", "bmi", "maths_11")


@query("join_semi", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def _(d: Data) -> DataFrame:
    good = d.table("labels", "doc_id", "quality", where=F.col("quality") == 1)
    return d.table("documents", "doc_id", "lang").join(good, "doc_id", "left_semi")


@query(
    "join_self_equi",
    """WITH a AS (SELECT DISTINCT cohort, age FROM bmi_long)
       SELECT x.cohort, x.age AS dep_age, y.age AS last_age FROM a x JOIN a y ON x.cohort = y.cohort""",
)
def _(d: Data) -> DataFrame:
    ages, _ = bounded(d.bmi_long().select("cohort", "age").distinct())
    left = ages.withColumnRenamed("age", "dep_age")
    return left.join(ages.withColumnRenamed("age", "last_age"), "cohort")


@query(
    "join_cross",
    """SELECT cohort, sex, mod, n FROM (SELECT cohort, count(*) AS n FROM members GROUP BY 1)
       CROSS JOIN (VALUES ('all'), ('male'), ('female')) s(sex) CROSS JOIN (VALUES ('basic'), ('sep'), ('early'), ('all')) t(mod)""",
)
def _(d: Data) -> DataFrame:
    cohorts = d.members().groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    grid = rs.expand_grid(cohorts, sex=["all", "male", "female"], mod=["basic", "sep", "early", "all"])
    return grid.select("cohort", "sex", "mod", "n")


@query(
    "join_theta",
    """SELECT x.id, x.age AS age_x, y.age AS age_y, round(y.bmi - x.bmi, 6) AS change FROM waves x JOIN waves y ON x.id = y.id AND x.age < y.age""",
)
def _(d: Data) -> DataFrame:
    waves = d.waves().select("id", "age", "bmi")
    pairs = inequality_join(waves, waves, "age", "<", "age", ["id"])
    change = F.round(F.col("bmi_right") - F.col("bmi"), 6).alias("change")
    return pairs.select("id", F.col("age").alias("age_x"), F.col("age_right").alias("age_y"), change)


_CELLS = "WITH a AS (SELECT cohort, age, count(*) AS n FROM bmi_long GROUP BY 1, 2) "


def cell_counts(d: Data) -> DataFrame:
    return stage(d.bmi_long().groupBy("cohort", "age").agg(F.count(F.lit(1)).alias("n")))


@query("join_theta_differ", _CELLS + "SELECT x.cohort, x.age AS age_x, y.age AS age_y, y.n - x.n AS more FROM a x JOIN a y ON x.cohort = y.cohort AND x.age != y.age")
def _(d: Data) -> DataFrame:
    cells = cell_counts(d)
    pairs = inequality_join(cells, cells, "age", "!=", "age", ["cohort"])
    return pairs.select("cohort", F.col("age").alias("age_x"), F.col("age_right").alias("age_y"), (F.col("n_right") - F.col("n")).alias("more"))


@query("join_theta_open", _CELLS + "SELECT x.cohort AS cohort_x, x.age AS age_x, y.cohort AS cohort_y, y.age AS age_y FROM a x JOIN a y ON x.n < y.n")
def _(d: Data) -> DataFrame:
    cells = cell_counts(d)
    pairs = inequality_join(cells, cells, "n", "<", "n", chunk_rows=8)
    return pairs.select(
        F.col("cohort").alias("cohort_x"), F.col("age").alias("age_x"), F.col("cohort_right").alias("cohort_y"), F.col("age_right").alias("age_y")
    )


@query(
    "join_key_align",
    "SELECT m.id, m.cog, w.bmi_20, i.maths_11, i.verbal_11 FROM members m JOIN wave_columns w ON m.id = w.id JOIN items i ON m.id = i.id",
)
def _(d: Data) -> DataFrame:
    blocks = [d.members().select("id", "cog"), d.wave_columns().select("id", "bmi_20"), d.items().select("id", "maths_11", "verbal_11")]
    return j.align_on_key(blocks, ["id"])


_BRACKET = """WITH ref AS (SELECT sex, age AS a0, lead(age) OVER (PARTITION BY sex ORDER BY age) AS a1,
       l AS l0, lead(l) OVER (PARTITION BY sex ORDER BY age) AS l1, m AS m0, lead(m) OVER (PARTITION BY sex ORDER BY age) AS m1,
       s AS s0, lead(s) OVER (PARTITION BY sex ORDER BY age) AS s1 FROM growth_reference),
  rows_ AS (SELECT id, male, bmi, age + CAST(id % 5 AS DOUBLE) AS age FROM bmi_long),
  lms AS (SELECT id, r.age, bmi, l0 + (r.age - a0) / (a1 - a0) * (l1 - l0) AS l, m0 + (r.age - a0) / (a1 - a0) * (m1 - m0) AS m,
          s0 + (r.age - a0) / (a1 - a0) * (s1 - s0) AS s
          FROM rows_ r LEFT JOIN ref ON male = sex AND r.age >= a0 AND r.age < a1) """


def lms_rows(d: Data) -> DataFrame:
    rows = d.bmi_long().select("id", F.col("male").alias("sex"), "bmi", (F.col("age") + (F.col("id") % 5).cast("double")).alias("age"))
    return j.interpolate_by_age(rows, d.growth_reference(), ["sex"], "age", ["l", "m", "s"])


@query("join_range_interpolate", _BRACKET + f"SELECT id, age, {q6('l')} AS l, {q6('m')} AS m, {q6('s')} AS s FROM lms")
def _(d: Data) -> DataFrame:
    return lms_rows(d).select("id", "age", r6("l").alias("l"), r6("m").alias("m"), r6("s").alias("s"))


# ---- sets and reshape --------------------------------------------------------------------------------------------


@query(
    "set_union_tagged",
    """SELECT 'members' AS source, id, cohort, cog AS value, CAST(NULL AS INTEGER) AS age FROM members
       UNION ALL SELECT 'waves', id, NULL, bmi, age FROM waves""",
)
def _(d: Data) -> DataFrame:
    parts = {
        "members": d.members().select("id", "cohort", F.col("cog").alias("value")),
        "waves": d.waves().select("id", F.col("bmi").alias("value"), "age"),
    }
    return cohort_union(parts, key="source").select("source", "id", "cohort", "value", "age")


_LONG = " UNION ALL ".join(f"SELECT id, cohort, '{b}' AS bmi_var, {b} AS bmi_value FROM members_wide" for b in BMI)


@query("rsh_wide_to_long", _LONG)
def _(d: Data) -> DataFrame:
    return rs.wide_to_long(d.members_wide(), ["id", "cohort"], "^bmi_", "bmi_var", "bmi_value")


@query(
    "rsh_long_to_wide",
    "SELECT id, " + ", ".join(f"max(bmi) FILTER (WHERE age = {a}) AS bmi_{a}" for a in AGES) + " FROM waves GROUP BY id",
)
def _(d: Data) -> DataFrame:
    return rs.long_to_wide(d.waves(), ["id"], "age", {"bmi": "bmi"}, AGES)


@query(
    "rsh_long_to_wide_multi",
    """SELECT user_id, """ + ", ".join(
        f"count(*) FILTER (WHERE event_type = '{e}') AS n_{e}, max(value) FILTER (WHERE event_type = '{e}') AS top_{e}"
        for e in ("click", "error", "purchase")) + " FROM events GROUP BY user_id",
)
def _(d: Data) -> DataFrame:
    levels = ["click", "error", "purchase"]
    counted = d.table("events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    )
    wide = rs.long_to_wide(counted, ["user_id"], "event_type", {"n": "n", "top": "top"}, levels)
    return wide.fillna(0, subset=[f"n_{e}" for e in levels])


@query(
    "rsh_stata_wide",
    "SELECT id, " + ", ".join(
        f"max(bmi) FILTER (WHERE age = {a}) AS bmi_{a}, max(self_report) FILTER (WHERE age = {a}) AS self_report_{a}" for a in AGES
    ) + " FROM waves GROUP BY id",
)
def _(d: Data) -> DataFrame:
    return rs.reshape_wide_unique(d.waves(), ["id"], "age", {"bmi": "bmi", "self_report": "self_report"}, AGES)


@query("rsh_split_names", "SELECT id, w.age, w.bmi, w.self_report FROM waves w")
def _(d: Data) -> DataFrame:
    long = rs.split_names_long(d.wave_columns(), ["id"], r"_\d\d$", ["bmi", "self_report"])
    return long.filter(F.col("bmi").isNotNull())


@query(
    "rsh_densify",
    """SELECT i.cohort, i.id, a.age, w.bmi FROM (SELECT DISTINCT cohort, id FROM bmi_long) i
       JOIN (SELECT DISTINCT cohort, age FROM bmi_long) a ON i.cohort = a.cohort LEFT JOIN waves w ON i.id = w.id AND a.age = w.age""",
)
def _(d: Data) -> DataFrame:
    return rs.densify(d.bmi_long().select("cohort", "id", "age", "bmi"), "cohort", "id", "age").select("cohort", "id", "age", "bmi")


@query(
    "rsh_replicate",
    """SELECT id, cohort, CAST(k AS INTEGER) AS copy FROM members, (SELECT unnest(range(1, 4)) AS k) WHERE k <= id % 4""",
)
def _(d: Data) -> DataFrame:
    return rs.replicate(d.members().select("id", "cohort"), F.col("id") % 4, "copy")


@query(
    "rsh_sequence_grid",
    """SELECT cohort, n, CAST(k AS DOUBLE) / 10 AS delta FROM (SELECT cohort, count(*) AS n FROM members GROUP BY 1),
       (SELECT unnest(range(-10, 11)) AS k)""",
)
def _(d: Data) -> DataFrame:
    counts = d.members().groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    return rs.sequence_grid(counts, "delta", -10, 10, 10)


@query(
    "set_analysis_samples",
    f"""WITH f AS (SELECT id, cohort, {' AND '.join(b + ' IS NOT NULL' for b in ADULT_BMI)} AS complete FROM members_wide)
        SELECT cohort, id, 'all' AS kind, NULL AS wave FROM f UNION ALL SELECT cohort, id, 'balanced', NULL FROM f WHERE complete
        UNION ALL SELECT cohort, id, 'covariates', NULL FROM members WHERE father_class IS NOT NULL AND mother_edu_level IS NOT NULL
        UNION ALL """ + " UNION ALL ".join(f"SELECT cohort, id, 'missing', '{b}' FROM members_wide WHERE {b} IS NULL" for b in ADULT_BMI),
)
def _(d: Data) -> DataFrame:
    wide = d.members_wide()
    ids = ["cohort", "id"]
    parts = [
        sm.analysis_samples(wide, ids, ADULT_BMI).withColumnRenamed("sample", "kind"),
        wide.dropna(subset=["father_class", "mother_edu_level"]).select(*ids, F.lit("covariates").alias("kind")),
        sm.missing_by_wave(wide, ids, ADULT_BMI).withColumn("kind", F.lit("missing")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*ids, "kind", "wave")


# ---- sort and sample ---------------------------------------------------------------------------------------------


@query("srt_multi_key", "SELECT cohort, id, cog FROM members ORDER BY cohort, cog DESC NULLS LAST, id")
def _(d: Data) -> DataFrame:
    return d.members().select("cohort", "id", "cog").orderBy("cohort", F.col("cog").desc_nulls_last(), "id")


@query(
    "srt_sample_k_per_group",
    f"""SELECT cohort, id, CAST(k AS INTEGER) AS draw FROM (SELECT cohort, id, row_number() OVER (PARTITION BY cohort ORDER BY u, id) AS k
        FROM (SELECT cohort, id, {hash_uniform_sql('id', '0')} AS u FROM members)) WHERE k <= 10""",
)
def _(d: Data) -> DataFrame:
    return sm.sample_per_group(d.members(), "cohort", "id", 10)


@query(
    "srt_rank_relabel",
    """WITH s AS (SELECT CAST(right(name, 1) AS INTEGER) AS class, round(sum(value) * 100 / sum(sum(value)) OVER (), 2) AS class_prop
                  FROM posteriors_long GROUP BY name),
            o AS (SELECT *, 'Class ' || CAST(row_number() OVER (ORDER BY class_prop DESC, class) AS VARCHAR) AS class_ord FROM s)
       SELECT class, class_ord, class_prop, class_ord || ' (' || printf('%.1f', class_prop) || '%)' AS class_long FROM o""",
)
def _(d: Data) -> DataFrame:
    return class_order(d.posteriors_long())


@query("sink_cohort_table", "SELECT id, age, bmi, cohort FROM bmi_long")
def _(d: Data) -> DataFrame:
    path = f"{shared_folder(d.spark)}/cohort_table_{uuid.uuid4().hex}"
    save_table(d.bmi_long().select("id", "age", "bmi", "cohort"), path)
    return load_table(d.spark, path)
