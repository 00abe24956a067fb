"""Repeatable splits and class balancing by a digest of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest_share(key: Column, salt: str = "") -> Column:
    """A repeatable number in [0, 1) per key."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") / float(16**7)


def split_name(key: Column, train_percent: int = 80) -> Column:
    """`train` or `test`; a key always falls on the same side."""
    digest = F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long")
    return F.when(digest % 100 < train_percent, "train").otherwise("test")


def train_test(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    side = split_name(F.col(key))
    return df.where(side == "train"), df.where(side == "test")


def balance_ratio(labelled: DataFrame) -> DataFrame:
    """Which class to thin out (0 = none) and the share of it to keep (-1 = all), one row."""
    pos, neg = F.col("pos"), F.col("neg")
    even = F.abs(pos - neg) / (pos + neg) < 0.05
    return (
        labelled.agg(
            F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
            F.count(F.when(F.col("label") == -1, 1)).alias("neg"),
        )
        .withColumns(
            {
                "sample_type": F.when(even, 0).when(pos >= neg, 1).otherwise(-1),
                "ratio": F.when(even, F.lit(-1.0))
                .when(pos >= neg, F.try_divide(neg, pos))
                .otherwise(F.try_divide(pos, neg)),
            }
        )
    )


def undersampled(labelled: DataFrame, key: str, salt: str = "balance") -> DataFrame:
    """Thin out the larger class until both have about the same size."""
    rule = balance_ratio(labelled).select(F.struct("sample_type", "ratio")).scalar()
    kept = (F.col("label") != rule["sample_type"]) | (
        digest_share(F.col(key), salt) <= rule["ratio"]
    )
    return labelled.where(kept)
