"""Means and deviations from weighted parts, for values of any offset.

A part is (n, mean, m2): how many values, their mean, and the sum of squared distances from that mean. A
single value that occurs n times is (n, value, 0). Parts of parts are parts again, so days add up to
windows. Distances are taken from the mean of the whole group before they are squared; the difference of
two large sums, which loses small deviations of large values, never occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _product(n: Column, value: Column) -> Column:
    return n.cast("double") * value


def with_group_mean(parts: DataFrame, keys: list[str], n: str, mean: str, name: str) -> DataFrame:
    """Add the mean over all parts of the row's group; parts without a value (null mean) do not count."""
    group = Window.partitionBy(*keys)
    weight = F.when(F.col(mean).isNotNull(), F.col(n))
    # From the least value on: a large common offset costs no digits.
    least = F.min(mean).over(group)
    distance = F.sum(_product(weight, F.col(mean) - least)).over(group) / F.sum(weight).over(group)
    return parts.withColumn(name, least + distance)


def squared_distances(n: str, mean: str, group_mean: str, m2: str | None = None) -> Column:
    """Aggregate: m2 of all parts together."""
    part = _product(F.col(n), (F.col(mean) - F.col(group_mean)) ** 2)
    return F.sum(part if m2 is None else part + F.col(m2))


def merged_parts(parts: DataFrame, keys: list[str], n: str = "n", mean: str = "mean", m2: str = "m2") -> DataFrame:
    """One part (n, mean, m2) per group."""
    centred = with_group_mean(parts.where(F.col(mean).isNotNull() & (F.col(n) > 0)), keys, n, mean, "_group_mean")
    return centred.groupBy(*keys).agg(
        F.sum(n).alias(n), F.any_value("_group_mean").alias(mean), squared_distances(n, mean, "_group_mean", m2).alias(m2)
    )


def deviation(n: Column, m2: Column) -> Column:
    """Population form."""
    return F.sqrt(F.try_divide(m2, n))
