"""First principal component of pairwise correlations: loadings, scores, summary."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.operators.joins import attach_stats
from cohortframe.operators.ranks import add_zscore
from cohortframe.session import bounded


def first_component(df: DataFrame, items: list[str], by: list[str]) -> DataFrame:
    """Per group: eigenvalue, loadings (positive sum) and each item's mean and sd.

    All pairwise correlations are one aggregate; only p x p numbers per group reach the eigen solver.
    """
    pairs = list(combinations(range(len(items)), 2))
    stats = df.groupBy(*by).agg(
        F.array(*[F.avg(c) for c in items]).alias("means"),
        F.array(*[F.stddev_samp(c) for c in items]).alias("sds"),
        F.array(*[F.corr(items[i], items[j]) for i, j in pairs]).alias("corrs"),
    )
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *[stats.schema[b] for b in by], T.StructField("eigenvalue", T.DoubleType()),
        T.StructField("loadings", array), T.StructField("means", array), T.StructField("sds", array),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                matrix = np.eye(len(items))
                for (i, j), r in zip(pairs, row.corrs):
                    matrix[i, j] = matrix[j, i] = r
                values, vectors = np.linalg.eigh(matrix)
                loading = vectors[:, -1] * np.sqrt(values[-1])
                total = loading.sum()
                # loadings that cancel leave the sign open: then the first one is positive
                flip = total < 0 if abs(total) > 1e-8 else loading[0] < 0
                loading = -loading if flip else loading
                out.append([*[getattr(row, b) for b in by], values[-1], loading, row.means, row.sds])
            yield pd.DataFrame(out, columns=schema.names)

    return stats.mapInPandas(solve, schema)


def pca_scores(df: DataFrame, items: list[str], by: list[str], out: str) -> DataFrame:
    """Standardised score of the first component per row; null if any item is null."""
    fits, _ = bounded(first_component(df, items, by))
    joined = attach_stats(df, fits, by)
    score = F.lit(0.0)
    for i, item in enumerate(items):
        z = (F.col(item) - F.col("means")[i]) / F.col("sds")[i]
        score = score + F.col("loadings")[i] / F.col("eigenvalue") * z
    scored = joined.withColumn("__score", score).drop("eigenvalue", "loadings", "means", "sds")
    return add_zscore(scored, "__score", by, out).drop("__score")


def pca_summary(df: DataFrame, items: list[str], by: list[str]) -> DataFrame:
    fits = first_component(df, items, by)
    squares = F.aggregate("loadings", F.lit(0.0), lambda a, b: a + b * b)
    return fits.select(*by, squares.alias("eigenvalue"), F.size("loadings").cast("long").alias("vars")).withColumn(
        "prop", F.col("eigenvalue") / F.col("vars")
    )
