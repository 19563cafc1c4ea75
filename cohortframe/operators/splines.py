"""Natural cubic splines: a lookup of B-spline based columns for distinct ages, and a row-level basis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.operators.joins import attach_stats
from cohortframe.operators.ranks import group_quantiles
from cohortframe.operators.regress import residualise
from cohortframe.session import bounded


def bspline(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """B-spline columns by the Cox-de Boor recursion; the last interval is closed on the right."""
    x = np.asarray(x, dtype=float)
    inside = (knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])
    last = np.flatnonzero(knots[:-1] < knots[1:])[-1]
    inside[x == knots[-1], last] = True
    basis = inside.astype(float)
    for d in range(1, degree + 1):
        width_left = knots[d:-1] - knots[: -d - 1]
        width_right = knots[d + 1:] - knots[1:-d]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(width_left > 0, (x[:, None] - knots[: -d - 1]) / width_left, 0.0)
            right = np.where(width_right > 0, (knots[d + 1:] - x[:, None]) / width_right, 0.0)
        basis = left * basis[:, :-1] + right * basis[:, 1:]
    return basis


def end_curvature(knots: np.ndarray) -> np.ndarray:
    """Second derivatives of the cubic columns at both ends, from differences of linear columns."""
    ends = np.array([knots[0], knots[-1]])
    values = bspline(ends, knots, 1)
    for d in (2, 3):
        lower = knots[d:-1] - knots[: -d - 1]
        upper = knots[d + 1:] - knots[1:-d]
        a = np.divide(d, lower, out=np.zeros_like(lower), where=lower > 0)
        b = np.divide(d, upper, out=np.zeros_like(upper), where=upper > 0)
        values = a * values[:, :-1] - b * values[:, 1:]
    return values


def natural_spline(x: np.ndarray, df: int, reference: np.ndarray | None = None) -> np.ndarray:
    """Natural cubic spline columns without intercept: knots at equal quantiles of ``reference``, ends at its range."""
    ref = np.asarray(x if reference is None else reference, dtype=float)
    low, high = ref.min(), ref.max()
    inner = np.quantile(ref, np.linspace(0, 1, df + 1)[1:-1]) if df > 1 else np.array([])
    knots = np.concatenate([[low] * 4, inner, [high] * 4])
    constraint = end_curvature(knots)[:, 1:]
    q, _ = np.linalg.qr(constraint.T, mode="complete")
    return bspline(x, knots, 3)[:, 1:] @ q[:, 2:]


def ns_lookup(df: DataFrame, x: str, by: list[str], degrees: int = 2, stub: str = "age_ns") -> DataFrame:
    """Spline columns of every distinct x (per group): a small table to join to rows.

    Only distinct values reach the grouped function: a few ages per group.
    """
    names = [f"{stub}{i}" for i in range(degrees + 1)]
    distinct = df.select(*by, x).dropna().distinct()
    schema = T.StructType([*[df.schema[b] for b in by], df.schema[x], *[T.StructField(n, T.DoubleType()) for n in names]])

    def basis(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(x).reset_index(drop=True)
        columns = natural_spline(rows[x].to_numpy(dtype=float), degrees)
        rows[names[0]] = 1.0
        for i in range(degrees):
            rows[names[i + 1]] = columns[:, i]
        return rows

    return distinct.groupBy(*by).applyInPandas(basis, schema)


def natural_columns(x: Column, knots: list[Column]) -> list[Column]:
    """Natural spline columns of row-level x by truncated powers on the unit interval; zero at the first knot,
    straight lines beyond the outer knots.

    They span the same functions as the lookup columns, so fits and residuals agree.
    """
    low, high = knots[0], knots[-1]
    u = (x - low) / (high - low)
    places = [(k - low) / (high - low) for k in knots[:-1]]
    cube = lambda v: F.when(v > 0, v * v * v).otherwise(0.0)
    pieces = [(cube(u - p) - cube(u - 1)) / (1 - p) for p in places]
    return [u] + [piece - pieces[-1] for piece in pieces[:-1]]


def add_natural_columns(df: DataFrame, x: str, by: list[str], degrees: int, stub: str = "__ns") -> DataFrame:
    """Row-level spline columns with knots at quantiles of x within the group."""
    probs = [i / degrees for i in range(degrees + 1)]
    knots, _ = bounded(group_quantiles(df.filter(F.col(x).isNotNull()), x, by, probs))
    joined = attach_stats(df, knots.withColumnRenamed("quantiles", "__knots"), by)
    columns = natural_columns(F.col(x).cast("double"), [F.col("__knots")[i] for i in range(degrees + 1)])
    return joined.withColumns({f"{stub}{i}": c for i, c in enumerate(columns, start=1)}).drop("__knots")


def residualise_spline(df: DataFrame, y: str, x: str, by: list[str], out: str, degrees: int = 2) -> DataFrame:
    """Residual of y on a natural spline of x within groups, null where either is null."""
    with_basis = add_natural_columns(df, x, by, degrees)
    names = [f"__ns{i}" for i in range(1, degrees + 1)]
    return residualise(with_basis, y, names, by, out).drop(*names)
