"""String and display helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_substring(column: Column, start: int, length: int | None = None) -> Column:
    """Substring from the left (start >= 1) or from the right (start < 0)."""
    return F.substr(column, F.lit(start), F.char_length(column) if length is None else F.lit(length))


def before_first(column: Column, separator: str) -> Column:
    """Text before the first separator; the whole text if there is none."""
    return F.substring_index(column, separator, 1)


def strip_punctuation(column: Column) -> Column:
    return F.regexp_replace(column, r"[^A-Za-z0-9]", "")


def fixed(column: Column, digits: int) -> Column:
    """A number as text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", column.cast("double"))


def estimate_text(beta: Column, low: Column, high: Column, digits: int = 2) -> Column:
    return F.concat(
        fixed(beta, digits), F.lit(" ("), fixed(low, digits), F.lit(", "), fixed(high, digits), F.lit(")")
    )


def thousands(column: Column, digits: int = 0) -> Column:
    return F.trim(F.format_number(column, digits))


def percent(column: Column, digits: int = 1) -> Column:
    return F.concat(fixed(column, digits), F.lit("%"))
