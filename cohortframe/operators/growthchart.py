"""Box-Cox distribution helpers: growth-chart z-scores and centiles from (mu, sigma, nu)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortframe.functions.normal import normal_quantile


def lms_zscore(x: Column, l: Column, m: Column, s: Column) -> Column:  # noqa: E741
    power = (F.pow(x / m, l) - 1) / (l * s)
    return F.when(l == 0, F.log(x / m) / s).otherwise(power)


def box_cox_centile(tau: Column, mu: Column, sigma: Column, nu: Column) -> Column:
    """Value at probability tau; null where the power has no real value."""
    z = normal_quantile(tau)
    inside = 1 + nu * sigma * z
    return F.when(nu == 0, mu * F.exp(sigma * z)).when(inside > 0, mu * F.pow(inside, 1 / nu))
