"""Lookups in small constant tables, expressed as columns instead of joins."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(column: Column, table: Mapping) -> Column:
    """Value for the key in a constant table, NULL when the key is unknown or NULL."""
    if not table:
        return F.lit(None)
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def order_in(column: Column, names, unknown: int) -> Column:
    """Position of a value in a fixed presentation order."""
    return F.coalesce(lookup(column, {name: i for i, name in enumerate(names)}), F.lit(unknown))


def first_match(cases, default: Column) -> Column:
    """CASE WHEN over ``(condition, value)`` pairs."""
    cases = list(cases)
    if not cases:
        return default
    start = F.when(cases[0][0], cases[0][1])
    return reduce(lambda acc, case: acc.when(case[0], case[1]), cases[1:], start).otherwise(default)
