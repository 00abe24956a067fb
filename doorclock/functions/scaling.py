"""Label transform, bounded scaling and exact numeric reads of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorclock.settings import SCALE_BOUNDS


def compress(label: Column) -> Column:
    """log(1 + x), against the long right tail of durations."""
    return F.log1p(label)


def expand(value: Column) -> Column:
    """Inverse of `compress`."""
    return F.expm1(value)


def scaled(name: str, value: Column) -> Column:
    """Min-max scale by the fixed bounds: capped at 1, open below 0."""
    low, high = SCALE_BOUNDS[name]
    unit = (value - low) / (high - low)
    return F.when(unit > 1, F.lit(1.0)).otherwise(unit)


def number(column: Column) -> Column:
    """Double, or null where the text is not a number."""
    return column.try_cast("double")


def whole(column: Column) -> Column:
    """The number cut to its whole part (text such as 3.7 included)."""
    return number(column).try_cast("long")
