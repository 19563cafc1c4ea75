"""Grouped sufficient statistics as Catalyst sums, and the small solves on their result rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def cross_products(df: DataFrame, by: list[str], columns: list[Column], weight: Column | None = None) -> DataFrame:
    """n and the array of weighted cross products (upper triangle, row by row) per group.

    Sums combine before the shuffle, so only one short row per group and task moves.
    """
    w = F.lit(1.0) if weight is None else weight
    names = [f"__v{i}" for i in range(len(columns))]
    rows = df.select(*by, *[c.alias(n) for c, n in zip(columns, names)], w.alias("__w"))
    sums = [F.sum(F.col("__w") * F.col(names[i]) * F.col(names[j])).alias(f"__s{i}_{j}") for i, j in pairs(len(names))]
    grouped = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    return grouped.select(*by, "n", F.array(*[f"__s{i}_{j}" for i, j in pairs(len(names))]).alias("moments"))


def full_matrix(flat, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    upper = np.triu_indices(k)
    out[upper] = np.asarray(flat, dtype=float)
    return out + np.triu(out, 1).T


def keep_independent(matrix: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Columns of a cross-product matrix that do not depend on earlier ones, in order."""
    work, kept = matrix.copy(), []
    for j in range(len(matrix)):
        if matrix[j, j] > 0 and work[j, j] > tolerance * matrix[j, j]:
            kept.append(j)
            work = work - np.outer(work[:, j], work[j]) / work[j, j]
    return kept


def invert(matrix: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Inverse on the independent columns, zero elsewhere; columns are scaled first."""
    kept = keep_independent(matrix)
    out = np.zeros_like(matrix)
    if kept:
        part = matrix[np.ix_(kept, kept)]
        scale = np.sqrt(np.diag(part))
        out[np.ix_(kept, kept)] = np.linalg.inv(part / np.outer(scale, scale)) / np.outer(scale, scale)
    return out, kept
