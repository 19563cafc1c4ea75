"""Descriptive aggregates: profiles, crosstabs, table one, correlations, density."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.operators.joins import attach_stats
from cohortframe.operators.ranks import add_scores, group_quantiles, group_stats
from cohortframe.session import bounded


def profile(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """n, missing %, mean, sd, min, max, coefficient of variation: one row per group and variable."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        by, columns, "variable", "value"
    )
    v = F.col("value")
    return long.groupBy(*by, "variable").agg(
        F.count(v).alias("n"),
        (100.0 * F.sum(v.isNull().cast("int")) / F.count(F.lit(1))).alias("missing"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv"),
    )


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "variable", "n_missing")


def crosstab(df: DataFrame, rows: str, columns: str, levels: list) -> DataFrame:
    """Two-way counts with a column for missing."""
    cells = [F.count_if(F.col(columns) == F.lit(v)).alias(f"n_{v}") for v in levels]
    return df.groupBy(rows).agg(*cells, F.count_if(F.col(columns).isNull()).alias("n_missing"))


def table_one(
    df: DataFrame, by: str, numeric: list[str], categorical: dict[str, list], weight: str | None = None
) -> DataFrame:
    """One row per group, variable and level: n, percent of valid, mean, sd, missing percent.

    Every statistic is a sum over the same pass, so the result is one aggregate with no exploded rows. Stacked
    imputations average themselves, as each holds the same members.
    """
    total = F.count(F.lit(1))
    w = F.lit(1.0) if weight is None else F.col(weight)
    none = F.lit(None).cast("double")

    def item(variable: str, level: str, n, pct=none, mean=none, sd=none, missing=none):
        names = dict(variable=F.lit(variable), level=F.lit(level), n=n, pct=pct, mean=mean, sd=sd, missing=missing)
        return F.struct(*[value.alias(name) for name, value in names.items()])

    items = [item("n", "n", total)]
    for c in numeric:
        x, known = F.col(c), F.when(F.col(c).isNotNull(), w)
        mean = F.sum(known * x) / F.sum(known)
        squares = F.sum(known * x * x) - F.sum(known) * mean * mean
        sd = F.stddev_samp(x) if weight is None else F.sqrt(squares / (F.sum(known) - 1))
        missing = 100.0 * F.count_if(x.isNull()) / total
        items.append(item(c, c, F.count(x), mean=mean, sd=sd, missing=missing))
    for c, levels in categorical.items():
        x = F.col(c)
        valid = F.sum(F.when(x.isNotNull(), w))
        missing = 100.0 * F.count_if(x.isNull()) / total
        for level in levels:
            hit = F.sum(F.when(x == F.lit(level), w).otherwise(0.0))
            items.append(
                item(c, str(level), F.count_if(x == F.lit(level)), pct=F.try_divide(100.0 * hit, valid), missing=missing)
            )
    grouped = df.groupBy(by).agg(F.array(*items).alias("__rows"))
    return grouped.select(by, F.explode("__rows").alias("r")).select(by, "r.*")


def corr_matrix(df: DataFrame, columns: list[str], by: list[str] | None = None, pairwise: bool = True) -> DataFrame:
    """Pearson correlations of all pairs in one aggregate: pairwise-complete, or on complete rows."""
    data = df if pairwise else df.dropna(subset=columns)
    by = by or []
    pairs = list(combinations(columns, 2))
    wide = data.groupBy(*by).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs
    ])
    return wide.select(*by, F.explode(rows).alias("p")).select(*by, "p.*")


def spearman(df: DataFrame, pairs: list[tuple[str, str]], by: list[str], max_group_rows: int | None = None) -> DataFrame:
    """Spearman correlation per pair of columns: average ranks among the pair's complete rows, then Pearson."""
    options = {} if max_group_rows is None else {"max_group_rows": max_group_rows}
    rows = F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("vx"),
                 F.col(b).cast("double").alias("vy")) for a, b in pairs
    ])
    long = df.select(*by, F.explode(rows).alias("p")).select(*by, "p.*").dropna(subset=["vx", "vy"])
    keys = [*by, "x", "y"]
    ranked = add_scores(long, "vx", keys, {"average": "rx"}, **options)
    ranked = add_scores(ranked, "vy", keys, {"average": "ry"}, **options)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def share_of_total(df: DataFrame, by: list[str], within: list[str], out: str = "share") -> DataFrame:
    """Counts per cell and their share of the count of ``within``; the window runs over cells, not rows."""
    cells = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn(out, F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def kernel_density(df: DataFrame, x: str, by: list[str], points: int = 512) -> DataFrame:
    """Gaussian kernel density on an even grid three bandwidths beyond the range.

    Rows are first binned linearly onto the grid (an aggregate of at most ``points`` cells per group); a group's cells
    are then convolved with the kernel by a Fourier transform, so the work after the first pass does not depend on the
    number of rows. Binning moves a density by at most step^2 / (8 sqrt(2 pi) bandwidth^3).
    """
    stats, _ = group_stats(df, x, by)
    quartiles = group_quantiles(df.filter(F.col(x).isNotNull()), x, by, [0.25, 0.75])
    limits = df.groupBy(*by).agg(F.min(x).alias("__min"), F.max(x).alias("__max"))
    frame = attach_stats(stats, bounded(quartiles)[0], by)
    frame = attach_stats(frame, bounded(limits)[0], by)
    iqr = (F.element_at("quantiles", 2) - F.element_at("quantiles", 1)) / 1.34
    spread = F.when(F.least(F.col("__sd"), iqr) > 0, F.least(F.col("__sd"), iqr)).otherwise(F.col("__sd"))
    frame = frame.filter(F.col("__sd") > 0).withColumn(
        "__bw", F.lit(0.9) * spread * F.pow(F.col("__n").cast("double"), F.lit(-0.2))
    )
    frame = frame.select(
        *by, "__n", "__bw", (F.col("__min") - 3 * F.col("__bw")).alias("__from"),
        ((F.col("__max") - F.col("__min") + 6 * F.col("__bw")) / (points - 1)).alias("__step"),
    )
    frame, _ = bounded(frame)
    rows = attach_stats(df.filter(F.col(x).isNotNull()).select(*by, x), frame, by).filter(F.col("__bw").isNotNull())
    place = (F.col(x) - F.col("__from")) / F.col("__step")
    low = F.floor(place)
    ends = F.array(
        F.struct(low.alias("cell"), (1 - (place - low)).alias("mass")),
        F.struct((low + 1).alias("cell"), (place - low).alias("mass")),
    )
    bins = rows.select(*by, F.explode(ends).alias("e")).groupBy(*by, "e.cell").agg(F.sum("e.mass").alias("mass"))
    cells = bins.groupBy(*by).agg(F.collect_list("cell").alias("__cells"), F.collect_list("mass").alias("__mass"))
    cells = attach_stats(cells, frame, by)
    schema = T.StructType([
        *[cells.schema[g] for g in by], T.StructField("point", T.IntegerType()), T.StructField("x", T.DoubleType()),
        T.StructField("density", T.DoubleType()),
    ])

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spots = np.arange(points)
        for batch in batches:
            for row in batch.itertuples(index=False):
                values = dict(zip(batch.columns, row))
                mass = np.zeros(points)
                mass[np.asarray(values["__cells"], int)] = values["__mass"]
                gap = np.minimum(np.arange(2 * points), 2 * points - np.arange(2 * points)) * values["__step"] / values["__bw"]
                kernel = np.exp(-gap * gap / 2) / (math.sqrt(2 * math.pi) * values["__bw"])
                density = np.fft.irfft(np.fft.rfft(mass, 2 * points) * np.fft.rfft(kernel), 2 * points)[:points]
                yield pd.DataFrame({
                    **{g: pd.Series([values[g]] * points, dtype=batch[g].dtype) for g in by}, "point": spots,
                    "x": values["__from"] + spots * values["__step"], "density": np.maximum(density, 0.0) / values["__n"],
                })

    return cells.mapInPandas(smooth, schema)
