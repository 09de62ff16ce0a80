"""Counts, rates and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_true(condition: Column) -> Column:
    """Number of rows where the condition holds; a NULL condition counts as no."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def rows() -> Column:
    return F.count(F.lit(1))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE; NULL when the whole is zero (ANSI division would raise)."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    return F.round(ratio(part, whole), places)


def share_pct(part: Column, whole: Column, places: int = 1) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0)), places)


def exact_sum(column: Column, scale: int = 2) -> Column:
    """Sum of money amounts in DECIMAL, so that the order of addition cannot matter."""
    return F.sum(column.cast(f"decimal(18,{scale})")).cast("double")


def exact_total(column: str, scale: int = 4) -> Column:
    """Sum of a measure in DECIMAL, which can be added up further in any order."""
    return F.sum(F.col(column).cast(f"decimal(18,{scale})"))


def exact_mean(column: Column, places: int) -> Column:
    """Mean of values rounded to ``places``; the sum is taken in DECIMAL, so row order cannot matter."""
    return exact_sum(column, places) / F.count(column)


def null_to_zero(column: Column) -> Column:
    """Number for presentation: anything that is not numeric becomes 0.0."""
    return F.coalesce(column.try_cast("double"), F.lit(0.0))
