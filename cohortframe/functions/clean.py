"""Cleaning rules as Column expressions, with the missing-value rules spelled out.

A comparison with a missing value counts as false here, so a derived value is missing whenever its condition is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def derive_if(value: Column, condition: Column) -> Column:
    return F.when(condition, value)


def replace_if(column: Column, value: Column, condition: Column) -> Column:
    return F.when(condition, value).otherwise(column)


def not_equal(column: Column, value: object) -> Column:
    """Inequality that is true for a missing left side."""
    return ~column.eqNullSafe(F.lit(value))


def null_codes(column: Column, codes: tuple = (), below: float | None = None) -> Column:
    """Sentinel codes, and optionally all values below a bound, become null."""
    keep = column.isNotNull()
    if codes:
        keep = keep & ~column.isin(*codes)
    if below is not None:
        keep = keep & (column >= below)
    return F.when(keep, column)


def null_outside(column: Column, low: float, high: float, ends: str = "closed") -> Column:
    """Plausibility window: ``closed`` keeps the end values, ``open`` drops them too."""
    if ends == "open":
        return F.when((column > low) & (column < high), column)
    return F.when(column.between(low, high), column)


def in_range(column: Column, low: float, high: float) -> Column:
    """0/1 flag; missing is 0."""
    return F.coalesce(column.between(low, high), F.lit(False)).cast("int")


def recode(column: Column, mapping: dict) -> Column:
    """New code for each listed code; a target of None and unlisted codes are null."""
    live = [(old, new) for old, new in mapping.items() if new is not None]
    first, *rest = live
    chain = F.when(column == first[0], F.lit(first[1]))
    for old, new in rest:
        chain = chain.when(column == old, F.lit(new))
    return chain


def reverse_code(column: Column, total: int, low: int, high: int) -> Column:
    return F.when(column.between(low, high), F.lit(total) - column)


def shift_cap(column: Column, shift: int, low: int, high: int, cap_to: int, cap_high: int) -> Column:
    """Shift values in [low, high]; values above up to ``cap_high`` get the top code."""
    return F.when(column.between(low, high), column - shift).when(
        (column > high) & (column <= cap_high), F.lit(cap_to)
    )


# Unit factors (fixed values).
CM_PER_INCH = 2.54
KG_PER_OUNCE = 0.0283495
KG_PER_POUND = 0.454


def inches_to_m(column: Column) -> Column:
    return column * CM_PER_INCH / 100


def ounces_to_kg(column: Column) -> Column:
    return column * KG_PER_OUNCE


def stones_pounds_to_kg(stones: Column, pounds: Column) -> Column:
    return (stones * 14 + pounds) * KG_PER_POUND


def feet_inches_to_cm(feet: Column, inches: Column) -> Column:
    return (feet * 12 + inches) * CM_PER_INCH


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is null for a zero denominator."""
    return F.when(bottom != 0, top / bottom)


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    return ratio(weight_kg, F.pow(height_cm / 100, F.lit(2.0)))


def age_from_months(month: Column, year2: Column, birth_month_index: Column) -> Column:
    """Age in years from interview month and two-digit year (1900s) against a month index."""
    valid = (year2 >= 0) & (month >= 0)
    return F.when(valid, ((year2 * 12 + month) - birth_month_index) / 12.0)


def month_index(month: Column, year2: Column) -> Column:
    return year2 * 12 + month


def age_from_year2(year2: Column, birth_year2: int = 46) -> Column:
    """Age in a two-digit year for people born in ``birth_year2``; smaller years are after 2000."""
    return F.when(year2 < birth_year2, 100 - birth_year2 + year2).otherwise(year2 - birth_year2)


def zero_pad(column: Column, width: int = 2) -> Column:
    return F.lpad(column.cast("string"), width, "0")


def row_max(*columns: Column) -> Column:
    return F.greatest(*columns)


def first_valid(*columns: Column) -> Column:
    return F.coalesce(*columns)


def provenance(*sources: Column) -> Column:
    """1 if the first source has a value, 2 if only the second has, and so on."""
    chain = F.when(sources[0].isNotNull(), 1)
    for number, source in enumerate(sources[1:], start=2):
        chain = chain.when(source.isNotNull(), number)
    return chain


def missing_flag(column: Column) -> Column:
    return column.isNull().cast("int")


def any_missing(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def lookup(column: Column, table: dict) -> Column:
    pairs = [item for key, value in table.items() for item in (F.lit(key), F.lit(value))]
    return F.create_map(*pairs)[column]


def ordinal(column: Column, levels: list[str]) -> Column:
    """Position of a label in its level order, from 1; unknown labels are null."""
    position = F.array_position(F.array(*[F.lit(level) for level in levels]), column)
    return F.when(position > 0, position.cast("int"))
