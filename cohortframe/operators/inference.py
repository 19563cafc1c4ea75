"""Intervals, p-values and pooling over imputations. Inputs here are result rows, never data rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.functions.normal import Z975, normal_cdf, t_quantile, t_two_sided


def with_t_interval(df: DataFrame, beta: str = "beta", se: str = "se", dof: str = "df") -> DataFrame:
    """Adds stat, pval, lci, uci from the t distribution."""
    added = ("stat", "pval", "lci", "uci")
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in added]])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            stat = rows[beta] / rows[se].where(rows[se] > 0)
            rows["stat"] = stat
            rows["pval"] = [t_two_sided(s, d) for s, d in zip(stat, rows[dof])]
            known = {d: t_quantile(0.975, d) for d in set(rows[dof].dropna())}
            half = rows[se] * rows[dof].map(known)
            rows["lci"] = rows[beta] - half
            rows["uci"] = rows[beta] + half
            yield rows

    out = df.mapInPandas(extend, schema)
    return out.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in added})


def _rubin(df: DataFrame, by: list[str], beta: str, se: str, *extra) -> DataFrame:
    pooled = df.groupBy(*by).agg(
        F.count(beta).alias("m"),
        F.avg(beta).alias("beta"),
        F.avg(F.col(se) * F.col(se)).alias("__within"),
        F.coalesce(F.var_samp(beta), F.lit(0.0)).alias("__between"),
        *extra,
    )
    extra_var = (1 + 1 / F.col("m")) * F.col("__between")
    total = F.col("__within") + extra_var
    return pooled.withColumn("__share", F.when(total > 0, extra_var / total).otherwise(0.0)).withColumn("se", F.sqrt(total))


def pool_rubin(df: DataFrame, by: list[str], beta: str = "beta", se: str = "se", dof: str = "df") -> DataFrame:
    """Multiple-imputation estimate with small-sample degrees of freedom.

    One imputation, or no variation between them, leaves the complete-data degrees of freedom with their
    small-sample factor.
    """
    pooled = _rubin(df, by, beta, se, F.min(dof).alias("__nu"))
    lam, nu = F.col("__share"), F.col("__nu")
    observed = (nu + 1) / (nu + 3) * nu * (1 - lam)
    old = (F.col("m") - 1) / (lam * lam)
    degrees = F.when(lam > 0, old * observed / (old + observed)).otherwise(observed)
    out = pooled.withColumn("df", degrees).select(*by, "m", "beta", "se", "df")
    return with_t_interval(out)


def pool_normal(df: DataFrame, by: list[str], beta: str = "beta", se: str = "se") -> DataFrame:
    """The same estimate and total variance with a normal interval."""
    pooled = _rubin(df, by, beta, se).select(*by, "m", "beta", "se")
    return pooled.withColumns(
        {"lci": F.col("beta") - Z975 * F.col("se"), "uci": F.col("beta") + Z975 * F.col("se")}
    )


def pool_multi(df: DataFrame, by: list[str], beta: str = "beta", se: str = "se") -> DataFrame:
    """Pool each term of a vector with large-sample degrees of freedom."""
    pooled = _rubin(df, by, beta, se)
    lam = F.col("__share")
    degrees = F.when(lam > 0, (F.col("m") - 1) / (lam * lam)).otherwise(F.lit(float("inf")))
    return with_t_interval(pooled.withColumn("df", degrees).select(*by, "m", "beta", "se", "df"))


def pairwise_differences(results: DataFrame, same: list[str], label: list[str]) -> DataFrame:
    """All pairs of results that agree on ``same``: difference, z and lower-tail p."""
    keep = [*same, *label, "beta", "se"]
    x = results.select(*keep).withColumnsRenamed({c: f"{c}_x" for c in [*label, "beta", "se"]})
    y = results.select(*keep).withColumnsRenamed({c: f"{c}_y" for c in [*label, "beta", "se"]})
    pairs = x.join(y, same)
    spread = F.sqrt(F.pow("se_x", F.lit(2)) + F.pow("se_y", F.lit(2)))
    diff = pairs.withColumn("beta", F.col("beta_y") - F.col("beta_x")).withColumn("z", F.col("beta") / spread)
    labels = [f"{c}_{side}" for c in label for side in ("x", "y")]
    return diff.withColumn("p_lower", normal_cdf(F.col("z"))).select(*same, *labels, "beta", "z", "p_lower")


def odds_ratios(pooled: DataFrame, term: str, keep: str) -> DataFrame:
    """Exponentiated estimates and limits of the terms matching a pattern."""
    kept = pooled.filter(F.col(term).rlike(keep))
    return kept.withColumns({c: F.exp(c) for c in ("beta", "lci", "uci")})
