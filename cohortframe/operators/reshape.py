"""Person (wide) and person-wave (long) forms, grids and replication."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.functions.clean import zero_pad
from cohortframe.operators.joins import require_unique
from cohortframe.session import bounded


def wide_to_long(df: DataFrame, ids: list[str], pattern: str, name: str, value: str) -> DataFrame:
    """Columns matching a pattern become rows; missing values stay as rows."""
    columns = [c for c in df.columns if re.search(pattern, c)]
    return df.select(*ids, *columns).unpivot(ids, columns, name, value)


def long_to_wide(
    df: DataFrame, ids: list[str], name: str, values: dict[str, str], levels: list, pad: int | None = None
) -> DataFrame:
    """Rows become columns ``<stub>_<level>`` for every value column in one aggregate.

    ``values`` maps value columns to stubs, ``levels`` lists the known levels, so no job looks them up.
    """
    columns = []
    for column, stub in values.items():
        for level in levels:
            label = str(level).zfill(pad) if pad else str(level)
            alias = f"{stub}_{label}" if stub else label
            columns.append(F.max(F.when(F.col(name) == F.lit(level), F.col(column))).alias(alias))
    return df.groupBy(*ids).agg(*columns)


def reshape_wide_unique(
    df: DataFrame, ids: list[str], age: str, values: dict[str, str], ages: list[int]
) -> DataFrame:
    """Wide form with two-digit age suffixes; a repeated (id, age) fails the job."""
    unique = require_unique(df, [*ids, age], "long table")
    padded = unique.withColumn(age, zero_pad(F.col(age)))
    return long_to_wide(padded, ids, age, values, [str(a).zfill(2) for a in ages])


def split_names_long(df: DataFrame, ids: list[str], pattern: str, stubs: list[str]) -> DataFrame:
    """``<stub>_<age>`` columns to one row per age with a column per stub."""
    columns = [c for c in df.columns if re.search(pattern, c)]
    ages = sorted({c.rsplit("_", 1)[1] for c in columns})
    rows = [
        F.struct(
            F.lit(int(a)).alias("age"),
            *[(F.col(f"{s}_{a}") if f"{s}_{a}" in columns else F.lit(None)).alias(s) for s in stubs],
        )
        for a in ages
    ]
    return df.select(*ids, F.explode(F.array(*rows)).alias("w")).select(*ids, "w.*")


def densify(df: DataFrame, group: str, ident: str, age: str) -> DataFrame:
    """All ids of a group times all ages seen in that group; values of absent rows are null.

    A group's ages are a short list, so ids expand in place and only one join on (group, id, age) shuffles.
    """
    ages, _ = bounded(df.groupBy(group).agg(F.collect_set(age).alias("__ages")))
    frame = df.select(group, ident).distinct().join(ages, group).select(group, ident, F.explode("__ages").alias(age))
    return frame.join(df, [group, ident, age], "left")


def replicate(df: DataFrame, times: Column | int, index: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1; rows with 0 copies disappear."""
    count = F.lit(times) if isinstance(times, int) else times
    return df.filter(count > 0).withColumn(index, F.explode(F.sequence(F.lit(1), count.cast("int"))))


def sequence_grid(df: DataFrame, name: str, first: int, last: int, divisor: float) -> DataFrame:
    """Numeric grid first/divisor ... last/divisor attached to every row; integers underneath keep it exact."""
    steps = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("__step")
    return df.select("*", steps).withColumn(name, F.col("__step") / F.lit(float(divisor))).drop("__step")


def expand_grid(df: DataFrame, **levels: list) -> DataFrame:
    """Every row with every combination of literal levels, by exploding arrays in place."""
    for name, values in levels.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
