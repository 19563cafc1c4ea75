"""Design columns from a formula-like list of terms: factors become dummies, products become interactions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_columns(term: str, factors: dict[str, list]) -> dict[str, Column]:
    """Columns of one term; ``a:b`` is an interaction. The first level of a factor is the reference."""
    parts = []
    for name in term.split(":"):
        if name in factors:
            parts.append(
                {f"{name}{level}": (F.col(name) == F.lit(level)).cast("double") for level in factors[name][1:]}
            )
        else:
            parts.append({name: F.col(name).cast("double")})
    columns = {}
    for combination in product(*[p.items() for p in parts]):
        value = combination[0][1]
        for _, other in combination[1:]:
            value = value * other
        columns[":".join(name for name, _ in combination)] = value
    return columns


def design(df: DataFrame, terms: list[str], factors: dict[str, list], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """``keep`` columns and one double column per design column; ``a*b`` means a, b and a:b."""
    expanded: list[str] = []
    for term in terms:
        parts = term.split("*")
        wanted = [*parts, ":".join(parts)] if len(parts) > 1 else [term]
        expanded += [t for t in wanted if t not in expanded]
    columns: dict[str, Column] = {}
    for term in expanded:
        columns.update(term_columns(term, factors))
    selected = [value.alias(name) for name, value in columns.items() if name not in keep]
    return df.select(*keep, *selected), list(columns)
