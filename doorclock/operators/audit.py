"""Counts after each step, to see how many rows and orders a step keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from doorclock.operators.geofence import not_overdwell, valid_stay
from doorclock.settings import CURRENT, DwellRules


def step_counts(df: DataFrame, step: str, key: str) -> DataFrame:
    """Rows and distinct keys of one step."""
    return df.select(key).agg(
        F.lit(step).alias("step"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
    )


def funnel(steps: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row of counts per step."""
    return reduce(
        DataFrame.unionByName, [step_counts(df, name, key) for name, (df, key) in steps.items()]
    )


# Observed steps. The numbers are taken while a step's rows are written, in the last stage of that job, so
# that they cost no pass of their own and a repeated task counts once.


def observed(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds the metrics once the rows have been written."""
    taken = Observation()
    return df.observe(taken, *[F.coalesce(value, F.lit(0)).cast("long").alias(name) for name, value in metrics.items()]), taken


def observed_funnel(spark: SparkSession, counts: dict[str, tuple[int, int]]) -> DataFrame:
    """One row of counts per step, of numbers that are known."""
    return spark.createDataFrame([(step, n, k) for step, (n, k) in counts.items()], "step string, n_rows long, n_keys long")


def handover_metrics(rules: DwellRules = CURRENT) -> dict[str, Column]:
    """Rows and keys of the hand-over steps up to the dwell table, as metrics `<step>:rows`, `<step>:keys` of stays.

    A stay knows its number of positions, so the position-level steps need not be built. Stays have one row
    per order.
    """
    kept = not_overdwell(rules)
    valid = kept & valid_stay(rules)
    points = F.col("point_cnt")
    one = F.lit(1)
    steps = {
        "c1_in_circle": (points, one, F.lit(True)),
        "c2_overdwell": (one, one, ~kept),
        "c3_not_overdwell": (points, one, kept),
        "c4_dwell": (one, one, valid),
    }
    return {
        f"{step}:{what}": F.sum(F.when(test, value))
        for step, (rows, keys, test) in steps.items()
        for what, value in (("rows", rows), ("keys", keys))
    }


def metric_pairs(found: dict[str, int], steps: list[str]) -> dict[str, tuple[int, int]]:
    return {step: (found[f"{step}:rows"], found[f"{step}:keys"]) for step in steps}


def handover_funnel(stays: DataFrame, rules: DwellRules = CURRENT) -> DataFrame:
    """Counts of the hand-over steps up to the dwell table, from one pass over the stays.

    A stay knows its number of positions, so the position-level steps need not be built.
    `stays` has one row per order.
    """
    kept = not_overdwell(rules)
    valid = kept & valid_stay(rules)
    points = F.col("point_cnt")
    zero = F.lit(0).cast("long")

    def total(test) -> Column:
        return F.coalesce(F.sum(F.when(test, points)), zero)

    def orders(test) -> Column:
        return F.count(F.when(test, 1))

    everything = F.lit(True)
    steps = {
        "c1_in_circle": (total(everything), orders(everything)),
        "c2_overdwell": (orders(~kept), orders(~kept)),
        "c3_not_overdwell": (total(kept), orders(kept)),
        "c4_dwell": (orders(valid), orders(valid)),
    }
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("step"), n.alias("n_rows"), k.alias("n_keys"))
            for name, (n, k) in steps.items()
        ]
    )
    return stays.agg(rows.alias("steps")).select(F.inline("steps"))


def time_coverage(dwell: DataFrame) -> DataFrame:
    """First and last finish time."""
    return dwell.agg(
        F.min("finish_time").alias("min_finish_time"), F.max("finish_time").alias("max_finish_time")
    )


