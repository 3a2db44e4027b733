"""Three-valued facts: true, false and unknown (null) are kept apart in every rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(x: Column) -> Column:
    return x.eqNullSafe(F.lit(True))


def is_false(x: Column) -> Column:
    return x.eqNullSafe(F.lit(False))


def given(x: Column) -> Column:
    """A string that is neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def strings(x: Column) -> Column:
    """A field list as a set in order: null is empty, nulls and repeats go."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(x, F.array().cast("array<string>")))))


def stricter(before: Column, after: Column) -> Column:
    return is_false(before) & is_true(after)
