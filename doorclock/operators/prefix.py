"""Running totals and dense numbers over a whole table without one task seeing all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorclock.plans.staging import staged


def running_totals(
    df: DataFrame, bucket: Column, order: list[Column], totals: dict[str, str]
) -> DataFrame:
    """Add `totals[c]` = sum of column `c` over this row and all rows before it.

    `bucket` must be a whole number from a bounded range that never falls along `order`. Rows are
    summed within their bucket; the totals of the earlier buckets come from a table with one row
    per bucket, so its size is bounded by the range of `bucket`, not by the data.
    """
    sums = {c: f"_sum_{c}" for c in totals}
    buckets = (
        df.groupBy(bucket.alias("_bucket"))
        .agg(*[F.sum(c).alias(s) for c, s in sums.items()])
        .withColumn("_all", F.lit(0))
    )
    earlier = Window.partitionBy("_all").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        "_bucket",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in sums.values()],
    )
    within = (
        Window.partitionBy("_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("_bucket", bucket)
        .withColumns({name: F.sum(c).over(within) for c, name in totals.items()})
        .join(offsets, "_bucket")
        .withColumns({name: F.col(name) + F.col(sums[c]) for c, name in totals.items()})
        .drop("_bucket", *sums.values())
    )


def falling_totals(df: DataFrame, order: str, totals: dict[str, str]) -> DataFrame:
    """Add `totals[c]` = sum of column `c` over this row and all rows with a higher `order`.

    `order` is unique and may have any range. Rows are dealt into ranges of `order` at sampled places,
    so close values spread like any others; the totals of higher ranges come from one row per range.
    """
    sums = {c: f"_sum_{c}" for c in totals}
    # Written, so that the ranges are the same wherever they are read.
    ranged = staged(df.repartitionByRange(F.desc(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = ranged.groupBy("_range").agg(*[F.sum(c).alias(s) for c, s in sums.items()])
    higher = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", *[F.coalesce(F.sum(s).over(higher), F.lit(0)).alias(s) for s in sums.values()])
    within = Window.partitionBy("_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumns({name: F.sum(c).over(within) for c, name in totals.items()})
        .join(F.broadcast(offsets), "_range")  # as many rows as the shuffle has partitions
        .withColumns({name: F.col(name) + F.col(sums[c]) for c, name in totals.items()})
        .drop("_range", *sums.values())
    )


def key_digest_bucket(*keys: str) -> Column:
    """0..4095 from a digest of the key, so distinct keys spread evenly."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 3), 16, 10).cast("long")


def dense_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Number the rows of a table with a unique key 1..n, repeatably."""
    return running_totals(
        df.withColumn("_one", F.lit(1).cast("long")),
        key_digest_bucket(*keys),
        [F.col(k) for k in keys],
        {"_one": "id"},
    ).drop("_one")
