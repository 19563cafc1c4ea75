"""Column selection and naming by pattern, resolved on the schema at plan time."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, keep: str | None = None, drop: str | None = None) -> list[str]:
    names = df.columns
    if keep is not None:
        names = [n for n in names if re.search(keep, n)]
    if drop is not None:
        names = [n for n in names if not re.search(drop, n)]
    return names


def select_pattern(
    df: DataFrame,
    keep: str | None = None,
    drop: str | None = None,
    first: tuple[str, ...] = (),
    any_of: tuple[str, ...] = (),
) -> DataFrame:
    """``first`` columns, then columns matching ``keep`` but not ``drop``, then those of ``any_of`` that exist."""
    names = list(first)
    for name in matching(df, keep, drop) + [n for n in any_of if n in df.columns]:
        if name not in names:
            names.append(name)
    return df.select(*names)


def rename_pattern(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return df.withColumnsRenamed(
        {n: re.sub(pattern, replacement, n) for n in df.columns if re.search(pattern, n)}
    )


def across(
    df: DataFrame, columns: list[str], rules: dict[str, Callable[[Column], Column]], name: str = "{col}_{fn}"
) -> DataFrame:
    """Every rule applied to every column, under generated names."""
    return df.withColumns(
        {name.format(col=c, fn=fn): rule(F.col(c)) for c in columns for fn, rule in rules.items()}
    )


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose non-null values are all the same; an all-null column is not among them.

    One aggregate with min and max, so no set of distinct values is held.
    """
    row = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()
    return [c for c in columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] == row[f"hi_{c}"]]


def drop_constant(df: DataFrame, pattern: str) -> DataFrame:
    columns = matching(df, pattern)
    return df.drop(*constant_columns(df, columns)) if columns else df
