"""Model rows for the iterative fits: complete cases, numeric design, staged once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.session import stage


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every listed column known.

    One flag instead of a conjunction: with many design columns derived from the same few inputs, the optimizer's
    inference over the conjuncts would grow exponentially.
    """
    gaps = [F.col(f"`{c}`").isNull().cast("int") for c in columns]
    return df.filter(F.greatest(F.lit(0), *gaps) == 0)


def model_rows(
    df: DataFrame, by: list[str], level: str, levels: list[str], xs: list[str], weight: str | None
) -> DataFrame:
    """(by, __w, __y code from 0, __one, xs): rows with every value known, staged for repeated passes."""
    code = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(level)) - 1
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(
        *by, w.alias("__w"), F.when(code >= 0, code.cast("double")).alias("__y"), F.lit(1.0).alias("__one"),
        *[F.col(x).cast("double").alias(x) for x in xs],
    )
    return stage(complete_rows(rows, ["__w", "__y", *xs]), wide_design=True)


def numeric_rows(df: DataFrame, by: list[str], y: str, xs: list[str], key: str | None, weight: str | None) -> DataFrame:
    """(by, __key, __w, __y, __one, xs) as doubles on complete rows, staged for repeated passes."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = df.select(
        *by, (F.lit(0) if key is None else F.col(key)).cast("double").alias("__key"), w.cast("double").alias("__w"),
        F.col(y).cast("double").alias("__y"), F.lit(1.0).alias("__one"), *[F.col(x).cast("double").alias(x) for x in xs],
    )
    return stage(complete_rows(rows, ["__key", "__w", "__y", *xs]), wide_design=True)
