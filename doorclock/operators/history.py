"""History of shops and couriers from long-range deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from doorclock.operators.audit import observed


PHASES = ("a1_time", "a2_time")


def delivery_history(base: DataFrame, owner: str) -> DataFrame:
    """Deliveries and mean phase times per (owner, city)."""
    return base.groupBy(owner, "city_id").agg(
        F.count(F.lit(1)).alias("history_order_num"),
        F.avg("a1_time").alias("avg_a1_time"),
        F.avg("a2_time").alias("avg_a2_time"),
    )


def history_parts(base: DataFrame, owner: str, *also: str) -> DataFrame:
    """What `delivery_history` is the sum of: numbers and sums per (owner, city) and `also`, as the day."""
    return base.groupBy(*also, owner, "city_id").agg(
        F.count(F.lit(1)).alias("orders"),
        *[f(c).alias(f"{name}_{c}") for c in PHASES for f, name in ((F.count, "n"), (F.sum, "sum"))],
    )


def history_of_parts(parts: DataFrame, owner: str) -> DataFrame:
    """Deliveries and mean phase times per (owner, city) out of the parts of any days."""
    return parts.groupBy(owner, "city_id").agg(
        F.sum("orders").alias("history_order_num"),
        *[F.try_divide(F.sum(f"sum_{c}").cast("double"), F.sum(f"n_{c}")).alias(f"avg_{c}") for c in PHASES],
    )


def multi_city_owners(history: DataFrame, owner: str) -> DataFrame:
    """Owners with rows in more than one city."""
    return history.groupBy(owner).agg(F.count(F.lit(1)).alias("n_cities")).where("n_cities > 1")


def single_city(history: DataFrame, owner: str) -> DataFrame:
    """History rows of owners seen in one city only.

    The same rows as an anti-join with `multi_city_owners`: an owner left with one row keeps that
    row's values, so one aggregation by owner replaces the self-join.
    """
    return _by_owner(history, owner).where("_n = 1").select(*history.columns)


def _by_owner(history: DataFrame, owner: str) -> DataFrame:
    values = [c for c in history.columns if c != owner]
    return history.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in values])


def single_city_observed(history: DataFrame, owner: str) -> tuple[DataFrame, Observation]:
    """`single_city`, with the rows and owners of the history and of the result as metrics."""
    alone = F.sum(F.when(F.col("_n") == 1, 1))
    rows, taken = observed(_by_owner(history, owner), {"rows": F.sum("_n"), "owners": F.count(F.lit(1)), "single": alone})
    return rows.where("_n = 1").select(*history.columns), taken


def published_history(history: DataFrame, owner: str, run_time: str) -> DataFrame:
    """History with a surrogate id and the run's creation and update time."""
    return history.select(
        F.xxhash64(owner, "city_id").alias("id"),
        *history.columns,
        F.lit(run_time).alias("create_time"),
        F.lit(run_time).alias("update_time"),
    )
