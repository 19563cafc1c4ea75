"""Missing-value rules, names, merges: hand-made rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortframe.functions import clean as c
from cohortframe.operators import joins as j
from cohortframe.operators import ranks as rk
from cohortframe.operators import reshape as rs
from cohortframe.operators import samples as sm
from cohortframe.operators import select as sel
from cohortframe.sources.tables import cohort_union


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_missing_is_never_in_a_condition(spark):
    rows = [(1,), (-1,), (None,)]
    assert one(spark, rows, "x int", c.derive_if(F.col("x") * 2, F.col("x") >= 0)) == [2, None, None]
    assert one(spark, rows, "x int", c.in_range(F.col("x"), 0, 5)) == [1, 0, 0]
    assert one(spark, rows, "x int", c.not_equal(F.col("x"), 1)) == [False, True, True]


def test_range_ends(spark):
    rows = [(13.0,), (70.0,), (20.0,), (None,)]
    assert one(spark, rows, "x double", c.null_outside(F.col("x"), 13, 70, "open")) == [None, None, 20.0, None]
    assert one(spark, rows, "x double", c.null_outside(F.col("x"), 13, 70)) == [13.0, 70.0, 20.0, None]


def test_two_digit_years(spark):
    assert one(spark, [(45,), (46,), (99,), (9,)], "y int", c.age_from_year2(F.col("y"))) == [99, 0, 53, 63]


def test_ratio_and_row_max(spark):
    assert one(spark, [(1.0, 0.0), (1.0, 4.0)], "a double, b double", c.ratio(F.col("a"), F.col("b"))) == [None, 0.25]
    assert one(spark, [(None, 2), (3, None)], "a int, b int", c.row_max(F.col("a"), F.col("b"))) == [2, 3]


def test_recode_and_shift(spark):
    assert one(spark, [(50,), (2,), (7,)], "x int", c.recode(F.col("x"), {50: 1, 2: None})) == [1, None, None]
    shifted = c.shift_cap(F.col("x"), 9, 10, 19, 10, 30)
    assert one(spark, [(10,), (19,), (20,), (30,), (31,)], "x int", shifted) == [1, 10, 10, 10, None]


def test_constant_columns_keep_all_missing(spark):
    df = spark.createDataFrame([(1, 1, None, 1), (2, None, None, 2)], "id int, self_a int, self_b int, self_c int")
    assert sel.drop_constant(df, "^self_").columns == ["id", "self_b", "self_c"]


def test_merge_left_value_stands_even_if_null(spark):
    left = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    right = spark.createDataFrame([(1, 9), (3, 7)], "id int, v int")
    rows = {r.id: (r.v, r.m) for r in j.merge_one_to_one(left, right, ["id"], "m").collect()}
    assert rows == {1: (None, 3), 2: (5, 1), 3: (7, 2)}


@pytest.mark.parametrize("side", ["left", "right"])
def test_merge_refuses_repeated_keys(spark, side):
    once = spark.createDataFrame([(1, 1)], "id int, a int")
    twice = spark.createDataFrame([(1, 1), (1, 2)], "id int, b int")
    pair = (once, twice) if side == "right" else (twice, once)
    with pytest.raises(PySparkException, match="not unique"):
        j.merge_one_to_one(*pair, ["id"]).collect()


def test_many_to_one_keeps_repeats_on_the_left(spark):
    left = spark.createDataFrame([(1, 1), (1, 2)], "id int, a int")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "id int, b string")
    assert j.merge_many_to_one(left, right, ["id"]).count() == 3


@pytest.mark.parametrize("least", [1_000_000, 1])
def test_many_to_one_with_a_hot_key(spark, least):
    """A third of the rows on one key: the broadcast path and the plain one give the same full outer merge."""
    key = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40)
    left = spark.range(600).select("id", key.alias("k"), F.lit("l").alias("s"))
    right = spark.createDataFrame([(k, k * 10, "r") for k in range(5, 45)] + [(1, 10, "r")], "k long, v int, s string")
    rows = j.merge_many_to_one(left, right, ["k"], "m", least=least).collect()
    assert len(rows) == 600 + 5
    for r in rows:
        known = 5 <= r.k < 45 or r.k == 1
        assert r.m == (2 if r.id is None else 3 if known else 1)
        assert r.v == (r.k * 10 if known else None) and r.s == ("r" if r.id is None else "l")


def test_reshape_wide_refuses_repeated_waves(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 7, 2.0)], "id int, age int, bmi double")
    with pytest.raises(PySparkException, match="not unique"):
        rs.reshape_wide_unique(df, ["id"], "age", {"bmi": "bmi"}, [7]).collect()


def test_reshape_wide_pads_ages(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 16, 2.0)], "id int, age int, bmi double")
    row = rs.reshape_wide_unique(df, ["id"], "age", {"bmi": "bmi"}, [7, 16]).first()
    assert (row.bmi_07, row.bmi_16) == (1.0, 2.0)


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "id int, x int")
    b = spark.createDataFrame([(3,)], "id int")
    assert {(r.cohort, r.x) for r in cohort_union({"a": a, "b": b}).collect()} == {("a", 2), ("b", None)}


def test_dropout_and_retention(spark):
    rows = [("a", 1, 20, 1.0), ("a", 1, 30, 1.0), ("a", 2, 20, 1.0), ("a", 2, 40, 1.0), ("a", 3, 30, 1.0)]
    df = spark.createDataFrame(rows, "cohort string, id int, age int, bmi double")
    last = {r.id: r.last_age for r in sm.dropout_wave(df, "cohort", "id", "age", "bmi").collect()}
    assert last == {1: 30, 2: 20, 3: 30}
    row = sm.retention(df, "cohort", "id", 3).first()
    assert row.waves_1 == 100 and row.waves_2 == pytest.approx(200 / 3) and row.waves_3 is None


RANKED = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("a", 5.0), ("b", 3.0), ("c", None)]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_scores_with_nulls_ties_and_single_rows(spark, limit):
    """Both the window path and the value-count path."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RANKED)], "id int, g string, x double")
    kinds = {"rank": "rank", "ridit": "ridit", "dense": "dense", "std": "std", "average": "average"}
    out = {r.id: r for r in rk.add_scores(df, "x", ["g"], kinds, max_group_rows=limit, cells=2).collect()}
    assert len(out) == len(RANKED)
    assert [out[i].rank for i in range(7)] == [0.0, pytest.approx(1 / 3), pytest.approx(1 / 3), None, 1.0, None, None]
    assert [out[i].ridit for i in range(5)] == [0.125, 0.5, 0.5, None, 0.875]
    assert [out[i].dense for i in range(5)] == [1, 2, 2, None, 3]
    assert [out[i].average for i in range(5)] == [1.0, 2.5, 2.5, None, 4.0]
    assert out[5].std is None and out[6].std is None


def test_large_group_ranks_equal_window_ranks(spark):
    """Skewed groups, hot ties and heavy tails: value-range cells give the same scores as one window."""
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        F.when(F.col("id") % 4 == 0, F.lit(7.0)).when(F.col("id") % 31 == 0, None)
        .otherwise(F.exp((F.col("id") * 7919 % 2003) / 100.0)).alias("x"),
    )
    kinds = {k: k for k in ("rank", "ridit", "dense", "std")}
    small = {r.id: r for r in rk.add_scores(df, "x", ["g"], kinds).collect()}
    large = {r.id: r for r in rk.add_scores(df, "x", ["g"], kinds, max_group_rows=10, cells=4).collect()}
    assert len(large) == 6000
    for i, r in small.items():
        for k in kinds:
            assert (r[k] is None) == (large[i][k] is None)
            assert r[k] is None or large[i][k] == pytest.approx(r[k], abs=1e-12)


def test_large_group_quantiles_equal_exact(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 997).cast("double").alias("x"))
    probs = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    a = {r.g: r.quantiles for r in rk.group_quantiles(df, "x", ["g"], probs).collect()}
    b = {r.g: r.quantiles for r in rk.group_quantiles(df, "x", ["g"], probs, max_group_rows=10, cells=4).collect()}
    assert all(a[g] == pytest.approx(b[g]) for g in a)


def test_weighted_ranks_in_cells(spark, monkeypatch):
    df = spark.range(500).select(F.lit("a").alias("g"), (F.col("id") * 37 % 211).cast("double").alias("x"), (1 + F.col("id") % 3).cast("double").alias("w"))
    a = {r.x: r["__wrank"] for r in rk.weighted_value_ranks(df, "x", ["g"], "w").collect()}
    b = {r.x: r["__wrank"] for r in rk.weighted_value_ranks(df, "x", ["g"], "w", max_values=5).collect()}
    assert a == b


def test_group_ids_follow_key_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), ("b", 1), ("a", 9)], "cohort string, id int")
    ids = {(r.cohort, r.id): r.n for r in rk.group_ids(df, ["cohort", "id"], "n").collect()}
    assert ids == {("a", 9): 1, ("b", 1): 2, ("b", 2): 3}


def test_hot_lookup_equals_plain_join(spark):
    left = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 10).alias("k"))
    right = spark.createDataFrame([(k, k * 10) for k in range(10)], "k int, v int")
    hot = right.filter("k = 1")
    got = {r.id: r.v for r in j.lookup_hot(left, right, ["k"], hot).collect()}
    assert got == {r.id: r.k * 10 for r in left.collect()}


def test_scores_do_not_depend_on_partitioning(spark):
    df = spark.range(400).select("id", F.lit("a").alias("g"), (F.col("id") % 37).cast("double").alias("x"))
    a = {r.id: r.s for r in rk.add_scores(df.repartition(7), "x", ["g"], {"ridit": "s"}).collect()}
    b = {r.id: r.s for r in rk.add_scores(df.coalesce(1), "x", ["g"], {"ridit": "s"}).collect()}
    assert a == b and sum(a.values()) / 400 == pytest.approx(0.5)
