"""Linear regression by group: simple OLS, weighted least squares with robust errors, residuals, predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.operators.clean_rows import complete_rows
from cohortframe.operators.inference import with_t_interval
from cohortframe.operators.joins import attach_stats, join_null_safe
from cohortframe.operators.moments import cross_products, full_matrix, invert, pairs
from cohortframe.session import bounded


def simple_ols(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Slope of y on x per group with its t interval, from the built-in regression aggregates."""
    s = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("beta"),
        F.regr_sxx(y, x).alias("__sxx"),
        F.regr_syy(y, x).alias("__syy"),
        F.regr_sxy(y, x).alias("__sxy"),
    )
    df_ = (F.col("n") - 2).cast("double")
    rss = F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.col("__sxx")
    out = s.filter((F.col("__sxx") > 0) & (F.col("n") > 2)).select(
        *by, "n", "beta", F.sqrt(F.greatest(rss, F.lit(0.0)) / df_ / F.col("__sxx")).alias("se"), df_.alias("df")
    )
    return with_t_interval(out)


def _group_fields(df: DataFrame, by: list[str]) -> list[T.StructField]:
    return [df.schema[b] for b in by]


def _dot(values: list[Column], array: str, start: int = 0) -> Column:
    total = values[0] * F.col(array)[start]
    for i, v in enumerate(values[1:], start=1):
        total = total + v * F.col(array)[start + i]
    return total


def centred(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[float]]:
    """Subtract overall means (one aggregate), so that cross products keep their precision."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    means = [float(row[c] or 0.0) for c in columns]
    return df.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(columns, means)}), means


def fit_wls(df: DataFrame, y: str, xs: list[str], by: list[str], weight: str | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """Weighted least squares on complete rows.

    Returns the model rows (centred), one bounded row per group with ``beta``, ``inverse`` (flat), ``rss`` and ``df``,
    and the centring means of [*xs, y].
    """
    keep = list(dict.fromkeys([*by, y, *xs, *([weight] if weight else [])]))
    rows = df.select(*[F.col(c).cast("double").alias(c) if c in (y, *xs, weight) else F.col(c) for c in keep])
    rows = complete_rows(rows, [c for c in keep if c not in by])
    rows, means = centred(rows, [*xs, y])
    values = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    moments = cross_products(rows, by, values, F.col(weight) if weight else None)
    k = len(xs) + 1
    schema = T.StructType([
        *_group_fields(rows, by),
        T.StructField("n", T.LongType()),
        T.StructField("beta", T.ArrayType(T.DoubleType())),
        T.StructField("inverse", T.ArrayType(T.DoubleType())),
        T.StructField("rss", T.DoubleType()),
        T.StructField("df", T.DoubleType()),
        T.StructField("kept", T.ArrayType(T.IntegerType())),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                matrix = full_matrix(row["moments"], k + 1)
                inverse, kept = invert(matrix[:k, :k])
                beta = inverse @ matrix[:k, k]
                rss = max(matrix[k, k] - beta @ matrix[:k, k], 0.0)
                out.append([*[row[b] for b in by], row["n"], beta, inverse.ravel(), rss, float(row["n"] - len(kept)), kept])
            yield pd.DataFrame(out, columns=schema.names)

    fits, _ = bounded(moments.mapInPandas(solve, schema))
    return rows, fits, means


def uncentre(k: int, means: list[float]) -> np.ndarray:
    """Matrix that takes centred coefficients back to the original columns (without the outcome mean)."""
    transform = np.eye(k)
    transform[0, 1:] = -np.asarray(means[: k - 1])
    return transform


def wls_hc2(
    df: DataFrame, y: str, xs: list[str], by: list[str], weight: str | None = None, covariance: bool = False
) -> DataFrame:
    """Weighted least squares with heteroskedasticity-robust (leverage-corrected) errors and t intervals.

    One row per group and term; terms that depend on earlier ones have null estimates. With ``covariance`` one row per
    group with arrays ``beta`` and ``cov`` instead. Two aggregates: cross products, then leverage-weighted squares.
    """
    rows, fits, means = fit_wls(df, y, xs, by, weight)
    k = len(xs) + 1
    joined = attach_stats(rows, fits.select(*by, "beta", "inverse"), by)
    x = [F.lit(1.0), *[F.col(c) for c in xs]]
    w = F.col(weight) if weight else F.lit(1.0)
    staged = joined.withColumns(
        {"__e": F.col(y) - _dot(x, "beta"), **{f"__ax{i}": _dot(x, "inverse", i * k) for i in range(k)}}
    )
    leverage = x[0] * F.col("__ax0")
    for i in range(1, k):
        leverage = leverage + x[i] * F.col(f"__ax{i}")
    gap = 1 - w * leverage
    scale = F.when(gap > 1e-9, w * w * F.col("__e") * F.col("__e") / gap).otherwise(0.0)
    meat = cross_products(staged.withColumn("__g", scale), by, x, F.col("__g")).drop("n")
    merged = join_null_safe(meat, fits, by, "inner")
    names = ["(Intercept)", *xs]
    base = [*_group_fields(rows, by)]
    if covariance:
        schema = T.StructType([*base, T.StructField("n", T.LongType()), T.StructField("df", T.DoubleType()),
                               T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("cov", T.ArrayType(T.DoubleType()))])
    else:
        schema = T.StructType([*base, T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
                               T.StructField("beta", T.DoubleType()), T.StructField("se", T.DoubleType()), T.StructField("df", T.DoubleType())])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transform = uncentre(k, means)
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                inverse = np.asarray(row["inverse"]).reshape(k, k)
                cov = transform @ inverse @ full_matrix(row["moments"], k) @ inverse @ transform.T
                beta = transform @ np.asarray(row["beta"])
                beta[0] += means[-1]
                keys = [row[b] for b in by]
                if covariance:
                    out.append([*keys, row["n"], row["df"], beta, cov.ravel()])
                    continue
                for i, name in enumerate(names):
                    known = i in set(row["kept"])
                    out.append([*keys, name, row["n"], beta[i] if known else None,
                                float(np.sqrt(max(cov[i, i], 0.0))) if known else None, row["df"]])
            yield pd.DataFrame(out, columns=schema.names)

    result = merged.mapInPandas(finish, schema)
    return result if covariance else with_t_interval(result)


def residualise(df: DataFrame, y: str, xs: list[str], by: list[str], out: str) -> DataFrame:
    """Residual of y on xs within groups: fitted on complete rows, null where any input is null."""
    _, fits, means = fit_wls(df, y, xs, by)
    joined = attach_stats(df, fits.select(*by, F.col("beta").alias("__beta")), by)
    x = [F.lit(1.0), *[F.col(c) - F.lit(m) for c, m in zip(xs, means)]]
    return joined.withColumn(out, F.col(y) - F.lit(means[-1]) - _dot(x, "__beta")).drop("__beta")


def r_squared(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    rows, fits, _ = fit_wls(df, y, xs, by)
    total = rows.groupBy(*by).agg((F.var_pop(y) * F.count(F.lit(1))).alias("__tss"))
    return attach_stats(total, fits.select(*by, "n", "rss"), by).select(
        *by, "n", (1 - F.col("rss") / F.col("__tss")).alias("r2")
    )


def linear_contrasts(fits: DataFrame, weights: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Estimate and standard error of c'beta for contrast rows ``c`` (array) joined to fits on ``keys``."""
    joined = attach_stats(weights, fits.select(*keys, "beta", "cov"), keys)
    c = [F.col("c")[i] for i in range(size)]
    value = _dot(c, "beta")
    variance = F.lit(0.0)
    for i in range(size):
        variance = variance + c[i] * _dot(c, "cov", i * size)
    return joined.withColumn("estimate", value).withColumn("se", F.sqrt(F.greatest(variance, F.lit(0.0)))).drop("beta", "cov", "c")
