"""Bootstrap by Poisson(1) row weights drawn from a hash of (row key, replicate).

The weights approximate drawing n of n rows with replacement; they need no shuffle and do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.functions.draws import hash_uniform, hash_uniform_np, poisson_weight, poisson_weight_np
from cohortframe.operators.clean_rows import complete_rows
from cohortframe.operators.moments import full_matrix, invert, pairs
from cohortframe.operators.ranks import MAX_GROUP_ROWS, group_quantiles
from cohortframe.session import stage

TASK_REPLICATES = 20  # replicates of a group that share a task

def bootstrap_moments(
    df: DataFrame, key: str, columns: list[Column], by: list[str], replicates: int, seed: int = 1,
    weight: Column | None = None,
) -> DataFrame:
    """Weighted cross products for every group and replicate (``moments``, upper triangle).

    Each task turns its rows into one product matrix per group, so a replicate costs a matrix product and not a copy
    of the rows; what is shuffled are the per-task sums.
    """
    k = len(columns)
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(
        *by, F.col(key).cast("long").alias("__key"), w.cast("double").alias("__w"),
        *[c.cast("double").alias(f"__v{i}") for i, c in enumerate(columns)],
    )
    rows = complete_rows(rows, ["__w", *[f"__v{i}" for i in range(k)]])
    sums = [f"s{i}_{j}" for i, j in pairs(k)]
    schema = T.StructType([
        *[rows.schema[b] for b in by], T.StructField("replicate", T.IntegerType()),
        *[T.StructField(s, T.DoubleType()) for s in sums],
    ])
    numbers = np.arange(1, replicates + 1, dtype=np.int64)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for name, part in groups:
                values = part[[f"__v{i}" for i in range(k)]].to_numpy()
                products = np.column_stack([values[:, i] * values[:, j] for i, j in pairs(k)])
                products *= part["__w"].to_numpy()[:, None]
                u = hash_uniform_np(part["__key"].to_numpy()[None, :], numbers[:, None], seed)
                out = pd.DataFrame(poisson_weight_np(u) @ products, columns=sums)
                out.insert(0, "replicate", numbers.astype(np.int32))
                for position, b in enumerate(by):
                    out.insert(position, b, name[position])
                yield out

    grouped = rows.mapInPandas(partial, schema).groupBy(*by, "replicate")
    return grouped.agg(*[F.sum(s).alias(s) for s in sums]).select(
        *by, "replicate", F.array(*sums).alias("moments")
    )


def bootstrap_wls(
    df: DataFrame, key: str, y: str, xs: list[str], by: list[str], replicates: int, seed: int = 1,
    weight: str | None = None,
) -> DataFrame:
    """Coefficients of each replicate: one row per group, replicate and term."""
    columns = [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]
    sums = bootstrap_moments(df, key, columns, by, replicates, seed, F.col(weight) if weight else None)
    names, k = ["(Intercept)", *xs], len(xs) + 1
    schema = T.StructType([
        *[sums.schema[b] for b in by], sums.schema["replicate"], T.StructField("term", T.StringType()),
        T.StructField("beta", T.DoubleType()),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                matrix = full_matrix(row.moments, k + 1)
                inverse, kept = invert(matrix[:k, :k])
                beta = inverse @ matrix[:k, k]
                for i, name in enumerate(names):
                    out.append([*[getattr(row, b) for b in by], row.replicate, name, beta[i] if i in kept else None])
            yield pd.DataFrame(out, columns=schema.names)

    return sums.mapInPandas(solve, schema)


def percentile_interval(replicates: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median and 95% percentile limits over replicates (a bounded number of rows per group)."""
    q = group_quantiles(replicates, value, by, [0.5, 0.025, 0.975])
    return q.select(*by, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("median", "lci", "uci"))])


def weighted_spearman(x: np.ndarray, y: np.ndarray):
    """A function of whole-number row weights: the correlation of weighted average ranks (None where a variable does not
    vary), or no number at all without weight. Values are ordered once for all replicates."""
    places = [np.unique(v, return_inverse=True)[1] for v in (x, y)]
    counts = [int(p.max(initial=-1)) + 1 for p in places]

    def rho(w: np.ndarray) -> tuple[bool, float | None]:
        n = w.sum()
        if not n > 0:
            return False, None
        ranks, sums, squares = [], [], []
        for place, count in zip(places, counts):
            mass = np.bincount(place, w, count)
            rank = np.cumsum(mass) - mass + (mass + 1) / 2
            sums.append(mass @ rank)
            squares.append(mass @ (rank * rank))
            ranks.append(rank[place])
        (sx, sy), (sxx, syy) = sums, squares
        spread = (sxx - sx * sx / n) * (syy - sy * sy / n)
        return True, float((w @ (ranks[0] * ranks[1]) - sx * sy / n) / np.sqrt(spread)) if spread > 1e-9 else None

    return rho


def bootstrap_spearman(
    df: DataFrame, key: str, pairs_of: list[tuple[str, str]], by: list[str], replicates: int, seed: int = 1, unit_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Spearman correlation of every pair in every replicate, from weighted average ranks.

    A group of up to ``unit_rows`` rows goes to tasks of some replicates each, which order its values once. In larger ones rows
    carry their replicate weights, and each replicate is ranked within its own group key.
    """
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    run = _spearman_by_units if largest <= unit_rows else _spearman_by_rows
    return stage(run(df, key, pairs_of, by, replicates, seed))


def _spearman_by_units(df: DataFrame, key: str, pairs_of: list[tuple[str, str]], by: list[str], replicates: int, seed: int) -> DataFrame:
    columns = list(dict.fromkeys(c for pair in pairs_of for c in pair))
    names = {c: f"__v{i}" for i, c in enumerate(columns)}
    rows = df.select(*by, F.col(key).cast("long").alias("__key"), *[F.col(c).cast("double").alias(n) for c, n in names.items()])
    rows = rows.dropna(subset=["__key"]).withColumn("__first", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(TASK_REPLICATES))))
    schema = T.StructType([
        *[rows.schema[b] for b in by], T.StructField("x", T.StringType()), T.StructField("y", T.StringType()),
        T.StructField("replicate", T.IntegerType()), T.StructField("rho", T.DoubleType()),
    ])

    def correlate(group: tuple, part: pa.Table) -> pa.Table:
        first = group[-1].as_py()
        keys = part["__key"].to_numpy()
        values = {c: part[n].to_numpy() for c, n in names.items()}
        known = {pair: np.flatnonzero(~np.isnan(values[pair[0]]) & ~np.isnan(values[pair[1]])) for pair in pairs_of}
        each = [(*pair, at, weighted_spearman(values[pair[0]][at], values[pair[1]][at])) for pair, at in known.items()]
        found = []
        for replicate in range(first, min(first + TASK_REPLICATES, replicates + 1)):
            w = poisson_weight_np(hash_uniform_np(keys, np.int64(replicate), seed))
            for x, y, at, rho in each:
                some, value = rho(w[at])
                if some:
                    found.append((x, y, replicate, value))
        made = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.float64()))]
        fixed = [part[b].combine_chunks().take(pa.array(np.zeros(len(found), np.int64))) for b in by]
        return pa.table([*fixed, *made], names=schema.names)

    # replicates are a long computation on few rows: spread by groups and replicates, not by bytes
    spread = rows.repartition(64, *by, "__first")
    return spread.groupBy(*by, "__first").applyInArrow(correlate, schema)


def _spearman_by_rows(df: DataFrame, key: str, pairs_of: list[tuple[str, str]], by: list[str], replicates: int, seed: int) -> DataFrame:
    from cohortframe.operators.joins import join_null_safe
    from cohortframe.operators.ranks import weighted_value_ranks

    cells = F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("vx"), F.col(b).cast("double").alias("vy"))
        for a, b in pairs_of
    ])
    rows = df.select(*by, F.col(key).cast("long").alias("__key"), F.explode(cells).alias("p")).select(*by, "__key", "p.*")
    rows = rows.dropna(subset=["vx", "vy"]).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = rows.withColumn("w", poisson_weight(hash_uniform(F.col("__key"), F.col("replicate"), seed))).filter("w > 0")
    keys = [*by, "x", "y", "replicate"]
    cells = rows.groupBy(*keys, "vx", "vy").agg(F.sum("w").alias("w"))
    for value, out in (("vx", "rx"), ("vy", "ry")):
        ranks = weighted_value_ranks(cells, value, keys, "w").withColumnRenamed("__wrank", out)
        cells = join_null_safe(cells, ranks, [*keys, value], "inner")
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    s = cells.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * ry).alias("sxy"),
        F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"),
    )
    c = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    spread = c("sxx", "sx", "sx") * c("syy", "sy", "sy")
    # a replicate in which a variable does not vary has no correlation
    rho = F.when(spread > 1e-9, c("sxy", "sx", "sy") / F.sqrt(spread))
    return s.select(*keys, rho.alias("rho"))
