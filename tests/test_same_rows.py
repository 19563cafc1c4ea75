"""The same rows whatever the size limits, with missing keys and groups without values."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortframe import session
from cohortframe.functions.text import signed_substring
from cohortframe.operators import iterate, posteriors, ranks


@pytest.mark.parametrize("limit", [0, ranks.MAX_GROUP_ROWS])
def test_quantiles_of_groups_without_values(spark, limit):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None), ("b", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.quantiles for r in ranks.group_quantiles(df, "x", ["g"], [0.0, 0.5, 1.0], limit).collect()}
    assert got == {"a": [1.0, 2.0, 4.0], "b": None, None: [3.0, 4.0, 5.0]}


def test_eleven_classes(spark):
    shares = [1.0 + k for k in range(11)]
    rows = [(i, i % 11 + 1, *[s / sum(shares) for s in shares]) for i in range(22)]
    names = [f"prob{k}" for k in range(1, 12)]
    wide = spark.createDataFrame(rows, "id long, class int, " + ", ".join(f"{n} double" for n in names))
    long = wide.unpivot(["id", "class"], names, "name", "value")
    order = {r["class"]: r.class_ord for r in posteriors.class_order(long).collect()}
    assert order == {k: f"Class {12 - k}" for k in range(1, 12)}
    quality = {r.class_ord: r for r in posteriors.class_quality(long, list(range(1, 12))).collect()}
    assert len(quality) == 11 and quality["Class 11"].prop1 == pytest.approx(round(11 / 66, 3))
    assert quality["Class 1"].prop11 == pytest.approx(round(1 / 66, 3))


@pytest.mark.parametrize("keys", [["g"], ["k"], ["g", "k"]])
def test_sums_of_missing_keys(spark, keys):
    df = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0), (None, None, 4.0), ("a", None, 8.0)], "g string, k int, x double")
    found = [tuple(r[c] for c in keys) for r in df.select(*keys).distinct().collect()]
    tasks = {(key, 0): None for key in found}
    got = iterate.grouped_sums(df, keys, ["x"], lambda values, _: values.sum(0), tasks)
    want = {tuple(r[c] for c in keys): r.s for r in df.groupBy(*keys).agg(F.sum("x").alias("s")).collect()}
    assert {k[0]: v[0] for k, v in got.items()} == want


def test_long_text_is_whole(spark):
    df = spark.createDataFrame([("ab" * 600_000,)], "t string")
    row = df.select(F.length(signed_substring(F.col("t"), 3)).alias("n"), signed_substring(F.col("t"), -3).alias("r"), signed_substring(F.col("t"), 2, 3).alias("m")).first()
    assert (row.n, row.r, row.m) == (1_199_998, "bab", "bab")


def test_bounded_counts_values(spark):
    wide = spark.range(5_000).select("id", F.array(F.lit(1.0)).alias("v"))
    assert session.bounded(spark.range(5_000).toDF("id"))[1] and not session.bounded(wide)[1]
    assert session.bounded(wide)[0].count() == 5_000


def test_plain_key():
    assert iterate.plain_key((float("nan"), None, pd.NaT, "a", 1.0)) == (None, None, None, "a", 1)


def test_rank_correlations_of_replicates(spark):
    """Whole groups in a task or rows with their weights: ties, missing values and keys, repeated keys, a missing group, no spread."""
    from cohortframe.operators import bootstrap

    nan = float("nan")
    rows = [(i % 40 if i != 5 else None, "abcd"[i % 4] if i % 9 else None, float(i * 7 % 13), [None, nan, -0.0][i % 3] if i < 12 else float(i * 5 % 11), 1.0) for i in range(120)]
    rows = [(*r[:2], None, *r[3:]) if r[1] == "d" else r for r in rows]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, z double")
    n = bootstrap.TASK_REPLICATES + 2
    plans = [bootstrap.bootstrap_spearman(df, "id", [("x", "y"), ("y", "z")], ["g"], n, unit_rows=limit) for limit in (1000, 0)]
    units, by_rows = ({(r.g, r.x, r.y, r.replicate): r.rho for r in plan.collect()} for plan in plans)
    assert set(units) == set(by_rows) and len({k[0] for k in units if k[1] == "x"}) == 4 and len(units) == 9 * n
    assert all(v is None if by_rows[k] is None else v == pytest.approx(by_rows[k], abs=1e-12) for k, v in units.items())
    assert any(v is not None for v in units.values()) and all(v is None for k, v in units.items() if k[2] == "z")
