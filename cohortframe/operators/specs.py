"""Specification curves: every model of a grid, over all imputations, from a few grouped aggregates.

Rows are scored once per (cohort, imputation, sex stratum). Cross products of ONE vector that holds every covariate,
every exposure score and every outcome score are summed per (cohort, imp, sex, sample, wave, test, missing pattern);
each model of the grid is then a sub-block of those sums. A second pass adds the leverage-corrected residual squares
for all models at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.operators.design import term_columns
from cohortframe.operators.inference import pool_rubin
from cohortframe.operators.iterate import plain_key
from cohortframe.operators.joins import join_null_safe
from cohortframe.operators.moments import cross_products, full_matrix, invert
from cohortframe.operators.ranks import add_scores_many
from cohortframe.session import bounded, stage


@dataclass(frozen=True)
class Grid:
    """What to cross: outcome columns, exposure columns (``headline`` ones get every combination), covariate sets."""

    outcomes: list[str]
    exposures: list[str]
    headline: list[str]
    mods: dict[str, list[str]]
    factors: dict[str, list] = field(default_factory=dict)
    outcome_scores: tuple[str, ...] = ("raw", "std", "rank")
    exposure_scores: tuple[str, ...] = ("ridit", "rank", "std")
    cohort: str = "cohort"
    weight: str = "survey_weight"
    sex: str = "male"


SPEC_KEYS = ["cohort", "sex", "sample", "bmi_var", "cog_var"]
BROADCAST_FITS = 20_000
SALT_ROWS = 200_000


def _model_rows(stack: DataFrame, grid: Grid) -> tuple[DataFrame, dict[str, list[str]], list[str]]:
    """Scored long rows, the design columns of each covariate set, and all design columns."""
    own = F.when(F.col(grid.sex) == 1, "male").otherwise("female")
    needed = list(dict.fromkeys([t for ts in grid.mods.values() for t in ts] + grid.outcomes + grid.exposures))
    stack = stack.select(grid.cohort, "imp", "id", grid.sex, grid.weight, "missing_waves", *needed)
    # members of unknown sex or weight are in no model
    stack = stack.where(F.col(grid.sex).isNotNull() & F.col(grid.weight).isNotNull())
    strata = stack.withColumn("sex", F.explode(F.array(F.lit("all"), own)))
    scored = add_scores_many(
        strata, {c: c for c in grid.outcomes}, [grid.cohort, "imp", "sex"], list(grid.outcome_scores)
    )
    scored = add_scores_many(
        scored, {c: c for c in grid.exposures}, [grid.cohort, "imp", "sex"], list(grid.exposure_scores)
    )
    # two passes read the scored rows: keep them instead of sorting every variable twice
    scored = stage(scored)
    columns = {m: [n for t in terms for n in term_columns(t, grid.factors)] for m, terms in grid.mods.items()}
    all_columns = list(dict.fromkeys(n for names in columns.values() for n in names))
    terms = list(dict.fromkeys(t for ts in grid.mods.values() for t in ts))
    values = reduce(lambda a, t: {**a, **term_columns(t, grid.factors)}, terms, {})
    complete = F.lit(0)
    for bit, names in enumerate(grid.mods.values()):
        known = reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in names], F.lit(True))
        complete = complete + known.cast("int") * (1 << bit)
    cells = F.array(*[
        F.struct(
            F.lit(y).alias("bmi_var"), F.lit(x).alias("cog_var"), F.lit(x in grid.headline).alias("headline"),
            *[F.col(f"{y}_{k}").alias(f"y_{k}") for k in grid.outcome_scores],
            *[F.col(f"{x}_{k}").alias(f"x_{k}") for k in grid.exposure_scores],
        )
        for y in grid.outcomes for x in grid.exposures
    ])
    balanced = F.size("missing_waves") == 0
    long = scored.select(
        F.col(grid.cohort).alias("cohort"), "imp", "id", "sex", F.col(grid.sex).cast("double").alias("d_sex"),
        F.col(grid.weight).alias("w"), balanced.alias("balanced"), complete.alias("complete"),
        *[F.coalesce(values[n], F.lit(0.0)).alias(f"d_{n}") for n in all_columns],
        F.explode(cells).alias("cell"),
    )
    x, y = F.col(f"cell.x_{grid.exposure_scores[-1]}"), F.col(f"cell.y_{grid.outcome_scores[0]}")
    usable = x.isNotNull() & y.isNotNull() & (F.col("cell.headline") | (F.col("sex") == "all"))
    samples = F.when(F.col("cell.headline") & F.col("balanced"), F.array(F.lit("all"), F.lit("balanced"))).otherwise(
        F.array(F.lit("all"))
    )
    rows = long.filter(usable).withColumn("sample", F.explode(samples)).select("*", "cell.*").drop("cell", "balanced")
    return rows, columns, all_columns


def spec_curve(stack: DataFrame, grid: Grid) -> DataFrame:
    """One row per specification and imputation: n, beta, se, df of the exposure.

    ``stack`` is keyed (cohort, imp, id) and carries ``missing_waves``, the outcomes missing before imputation.
    """
    rows, columns, design = _model_rows(stack, grid)
    keys = ["cohort", "imp", "sex", "sample", "bmi_var", "cog_var"]
    names = ["d_sex", *[f"d_{n}" for n in design]]
    xs = [f"x_{k}" for k in grid.exposure_scores]
    ys = [f"y_{k}" for k in grid.outcome_scores]
    vector = [F.lit(1.0), *[F.col(c) for c in [*names, *xs, *ys]]]
    place = {name: i for i, name in enumerate(["1", *names, *xs, *ys])}
    sums = cross_products(rows, [*keys, "complete", "headline"], vector, F.col("w"))
    mods = list(grid.mods)
    tagged = sums.withColumn(
        "mod", F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.lit(1 << i).alias("bit")) for i, m in enumerate(mods)]))
    ).filter(F.col("complete").bitwiseAND(F.col("mod.bit")) != 0)
    # at most 2^len(mods) missing patterns meet here
    width = len(vector)
    zero = F.array_repeat(F.lit(0.0), width * (width + 1) // 2)
    blocks = tagged.groupBy(*keys, "headline", F.col("mod.name").alias("mod"), F.col("mod.bit").alias("bit")).agg(
        F.sum("n").alias("n"), F.collect_list("moments").alias("parts")
    ).withColumn("moments", F.aggregate("parts", zero, lambda a, b: F.zip_with(a, b, lambda p, q: p + q))).drop("parts")
    size = 2 + len(names)
    double_array = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *[blocks.schema[c] for c in keys], blocks.schema["headline"], blocks.schema["mod"], blocks.schema["bit"],
        T.StructField("cog_score", T.StringType()), T.StructField("n", T.LongType()), T.StructField("df", T.DoubleType()),
        *[T.StructField(f"b_{k}", double_array) for k in grid.outcome_scores], T.StructField("inverse", double_array),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # model columns in order: intercept, exposure, sex, covariates
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                matrix = full_matrix(row.moments, width)
                used = {"d_sex", *[f"d_{n}" for n in columns[row.mod]]}
                slots = [(0, 0)] + [(2 + i, place[n]) for i, n in enumerate(names) if n in used]
                for kind in grid.exposure_scores:
                    order = [slots[0], (1, place[f"x_{kind}"]), *slots[1:]]
                    spot, index = [s for s, _ in order], [i for _, i in order]
                    inverse, kept = invert(matrix[np.ix_(index, index)])
                    wide = np.zeros((size, size))
                    wide[np.ix_(spot, spot)] = inverse
                    betas = []
                    for y in ys:
                        b = np.zeros(size)
                        b[spot] = inverse @ matrix[index, place[y]]
                        betas.append(b)
                    key = [getattr(row, c) for c in [*keys, "headline", "mod", "bit"]]
                    out.append([*key, kind, row.n, float(row.n - len(kept)), *betas, wide.ravel()])
            yield pd.DataFrame(out, columns=schema.names)

    fits = blocks.mapInPandas(solve, schema)
    scored = _leverage_sums(rows, fits, keys, names, grid, size)
    cells = F.array(*[
        F.struct(F.lit(k).alias("bmi_score"), F.col(f"beta_{k}").alias("beta"), F.sqrt(f"v_{k}").alias("se"))
        for k in grid.outcome_scores
    ])
    out = scored.select(*keys, "headline", "mod", "cog_score", "n", "df", F.explode(cells).alias("r")).select("*", "r.*")
    keep = F.col("headline") | (F.col("bmi_score") == grid.outcome_scores[0])
    out = out.filter(keep & (F.col("se") > 0))
    return out.select(*keys, "mod", "bmi_score", "cog_score", "n", "beta", "se", "df")


def _influence(rows: pd.DataFrame, fits: pd.DataFrame, names: list[str], grid: Grid, size: int) -> list[list]:
    """Per fit of one design cell: sum over its rows of (weighted influence on the exposure)^2 e^2 / (1 - leverage)."""
    covariates = rows[names].to_numpy(dtype=float)
    w, complete = rows["w"].to_numpy(dtype=float), rows["complete"].to_numpy()
    y = rows[[f"y_{k}" for k in grid.outcome_scores]].to_numpy(dtype=float)
    out = []
    for fit in fits.itertuples(index=False):
        used = (complete & fit.bit) != 0
        x = np.column_stack([
            np.ones(used.sum()), rows[f"x_{fit.cog_score}"].to_numpy(dtype=float)[used], covariates[used]
        ])
        inverse = np.asarray(fit.inverse, dtype=float).reshape(size, size)
        pull = x @ inverse
        gap = 1 - w[used] * np.einsum("ij,ij->i", pull, x)
        scale = np.where(gap > 1e-9, (w[used] * pull[:, 1]) ** 2 / np.where(gap > 1e-9, gap, 1.0), 0.0)
        beta = np.column_stack([getattr(fit, f"b_{k}") for k in grid.outcome_scores])
        e = y[used] - x @ beta
        out.append([fit.mod, fit.cog_score, *(scale @ (e * e))])
    return out


def _leverage_sums(rows, fits, keys, names, grid: Grid, size: int) -> DataFrame:
    """Robust variance of the exposure for every model, as sums of per-batch matrix products.

    Few fits travel to the tasks as a broadcast variable. Many fits are co-grouped with the rows of their cell, cells
    being cut by a salt so that no group exceeds ``SALT_ROWS`` rows by much.
    """
    fits, small = bounded(fits, BROADCAST_FITS)
    values = [f"v_{k}" for k in grid.outcome_scores]
    schema = T.StructType([
        *[rows.schema[c] for c in keys], T.StructField("mod", T.StringType()), T.StructField("cog_score", T.StringType()),
        *[T.StructField(v, T.DoubleType()) for v in values],
    ])
    xs = [f"x_{k}" for k in grid.exposure_scores]
    left = rows.select(*keys, "id", "w", "complete", *names, *xs, *[f"y_{k}" for k in grid.outcome_scores])
    if small:
        table = {plain_key(key): part for key, part in fits.toPandas().groupby(keys, dropna=False)}
        shared = rows.sparkSession.sparkContext.broadcast(table)

        def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for key, part in batch.groupby(keys, dropna=False):
                    key = plain_key(key)
                    if key in shared.value:
                        out += [[*key, *r] for r in _influence(part, shared.value[key], names, grid, size)]
                yield pd.DataFrame(out, columns=schema.names)

        partial = left.drop("id").mapInPandas(per_batch, schema)
    else:
        largest = fits.agg(F.max("n")).first()[0] or 0
        salts = int(largest // SALT_ROWS) + 1
        spread = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).drop("id")

        def per_cell(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if part.empty or own.empty:
                return pd.DataFrame(columns=schema.names)
            key = [part[k].iloc[0] for k in keys]
            return pd.DataFrame([[*key, *r] for r in _influence(part, own, names, grid, size)], columns=schema.names)

        on = [*keys, "salt"]
        partial = salted.groupBy(*on).cogroup(spread.groupBy(*on)).applyInPandas(per_cell, schema)
    sums = partial.groupBy(*keys, "mod", "cog_score").agg(*[F.sum(v).alias(v) for v in values])
    slim = fits.select(
        *keys, "mod", "cog_score", "headline", "n", "df", *[F.col(f"b_{k}")[1].alias(f"beta_{k}") for k in grid.outcome_scores]
    )
    return join_null_safe(sums, F.broadcast(slim) if small else slim, [*keys, "mod", "cog_score"], "inner")


def pooled_curve(fits: DataFrame) -> DataFrame:
    """Complete-case rows (imp 0) and pooled rows (imp > 0) as types ``cc`` and ``mi``."""
    typed = fits.withColumn("type", F.when(F.col("imp") == 0, "cc").otherwise("mi"))
    return pool_rubin(typed, ["type", *SPEC_KEYS, "mod", "bmi_score", "cog_score"])


def mnar_curve(stack: DataFrame, grid: Grid, outcome_sd: DataFrame, steps: list[float], scaled: bool = True) -> DataFrame:
    """Pattern-mixture sensitivity: outcomes missing before imputation shifted by delta (times the observed sd).

    The shifted outcome is y + delta * sd * missing, so estimates are linear and robust variances quadratic in
    delta: fitting y and the missing flag once per imputation gives every step of the grid.
    """
    scored = add_scores_many(stack, {x: x for x in grid.headline}, ["cohort", "imp"], ["std"])
    cells = F.array(*[
        F.struct(F.lit(y).alias("bmi_var"), F.lit(x).alias("cog_var"), F.col(y).alias("y"), F.col(f"{x}_std").alias("x"),
                 F.array_contains("missing_waves", y).cast("double").alias("m"))
        for y in grid.outcomes for x in grid.headline
    ])
    rows = scored.filter(F.col("imp") > 0).select(
        "cohort", "imp", F.col(grid.sex).cast("double").alias("sex"), F.col(grid.weight).alias("w"),
        F.explode(cells).alias("c")
    ).select("cohort", "imp", "sex", "w", "c.*").dropna()
    by = ["cohort", "imp", "bmi_var", "cog_var"]
    vector = [F.lit(1.0), F.col("x"), F.col("sex"), F.col("y"), F.col("m")]
    sums = cross_products(rows, by, vector, F.col("w"))
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *[sums.schema[c] for c in by], T.StructField("n", T.LongType()), T.StructField("df", T.DoubleType()),
        T.StructField("b_y", array), T.StructField("b_m", array), T.StructField("inverse", array),
    ])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                matrix = full_matrix(row.moments, 5)
                inverse, kept = invert(matrix[:3, :3])
                out.append([*[getattr(row, c) for c in by], row.n, float(row.n - len(kept)),
                            inverse @ matrix[:3, 3], inverse @ matrix[:3, 4], inverse.ravel()])
            yield pd.DataFrame(out, columns=schema.names)

    fits, _ = bounded(sums.mapInPandas(solve, schema))
    joined = join_null_safe(rows, fits, by, "inner")
    x = vector[:3]
    dot = lambda name, start=0: reduce(lambda a, b: a + b, [x[i] * F.col(name)[start + i] for i in range(3)])
    leverage = reduce(lambda a, b: a + b, [x[i] * dot("inverse", 3 * i) for i in range(3)])
    staged = joined.withColumns({
        "__gap": 1 - F.col("w") * leverage, "__a": F.col("w") * dot("inverse", 3),
        "__ey": F.col("y") - dot("b_y"), "__em": F.col("m") - dot("b_m"),
    })
    scale = F.when(F.col("__gap") > 1e-9, F.col("__a") * F.col("__a") / F.col("__gap")).otherwise(0.0)
    meat = staged.groupBy(*by).agg(
        F.any_value("df").alias("df"), F.any_value(F.col("b_y")[1]).alias("by"), F.any_value(F.col("b_m")[1]).alias("bm"),
        F.sum(scale * F.col("__ey") * F.col("__ey")).alias("vyy"), F.sum(scale * F.col("__ey") * F.col("__em")).alias("vym"),
        F.sum(scale * F.col("__em") * F.col("__em")).alias("vmm"),
    )
    with_sd = join_null_safe(meat, outcome_sd, ["cohort", "bmi_var"], "left")
    shift = F.col("delta") * (F.col("sd") if scaled else F.lit(1.0))
    shifted = with_sd.withColumn("delta", F.explode(F.array(*[F.lit(float(s)) for s in steps]))).select(
        *by, "delta", "df", (F.col("by") + shift * F.col("bm")).alias("beta"),
        F.sqrt(F.col("vyy") + 2 * shift * F.col("vym") + shift * shift * F.col("vmm")).alias("se"),
    )
    return pool_rubin(shifted, ["cohort", "bmi_var", "cog_var", "delta"])
