"""The first rows of each group, by steps that keep every task's share small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doorclock.plans.staging import staged

PART_ROWS, FEWER = 50_000, 16


def top_rows(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group in a total order, with `rank` from 1.

    A group may hold most rows of the table. So its rows are dealt into parts by a hash of the row, only
    the first ones of each part go on, and the parts become fewer by steps until one is left.
    """
    rows = staged(df.withColumn("_part", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), "ranked_rows")
    parts = max(1, -(-rows.count() // PART_ROWS))
    while True:
        window = Window.partitionBy(*group, F.pmod(F.col("_part"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)
        if parts == 1:
            return rows.drop("_part")
        rows, parts = rows.drop("rank"), -(-parts // FEWER)
