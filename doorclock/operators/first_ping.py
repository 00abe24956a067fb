"""Pick-up phase: where the courier was on accepting, and the plausibility filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from doorclock.functions.geo import distance_m
from doorclock.functions.times import format_epoch
from doorclock.settings import PICKUP, WAREHOUSE_ZONE, PickupRules

HOUR_S = 3600
TIMES_FINER = 4
POSITION = "struct<time:bigint,lat:double,lng:double>"


def supplier_enriched(deliveries: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Deliveries with the position and kind of their shop."""
    shop = suppliers.select(
        "supplier_id",
        F.col("supplier_lat").alias("supp_lat"),
        F.col("supplier_lng").alias("supp_lng"),
        "supplier_type_id",
    )
    return deliveries.join(shop, "supplier_id")


def plausible(rules: PickupRules = PICKUP) -> Column:
    """Durations and speed that a real pick-up can have; distance within the search limit."""
    return (
        (F.col("a1_time") <= rules.max_a1_s)
        & (F.col("a2_time") <= rules.max_a2_s)
        & (F.col("real_time_line_distance") < rules.max_distance_m)
        & (rules.max_speed_m_s * F.col("a1_time") > F.col("real_time_line_distance"))
    )


def _backwards(block: str, *within: str) -> WindowSpec:
    """A courier's rows of equal keys from the last to the first. At the same place a position, which has a `first`,
    comes before a probe, and the least of equal times last."""
    return Window.partitionBy("user_id", *within).orderBy(F.desc(block), F.desc("first"))


def _next_position(block: str, *within: str) -> Column:
    """The courier's first position at or after a row's place, of those with the same keys.

    Probes and positions lie in one table that is read backwards, so no pairs are formed.
    """
    so_far = _backwards(block, *within).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last("first", ignorenulls=True).over(so_far)


def _finer(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by key to more tasks than other shuffles have, as each task sorts its share of all positions or deliveries."""
    return rows.repartition(TIMES_FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_pings(deliveries: DataFrame, pings: DataFrame) -> DataFrame:
    """Deliveries with the first position of their courier at or after accepting and not after fetching.

    Of rows that share a delivery id, the one with the earliest position stays (of equals, the one
    accepted first).
    """
    return earliest(found_pings(deliveries, pings))


def earliest(found: DataFrame) -> DataFrame:
    """Of `found_pings` of any couriers, each delivery id once."""
    order = F.struct("hit", "delivery.accept_time_unix", F.xxhash64("delivery"))
    return (
        found.groupBy("delivery.delivery_id")
        .agg(F.min_by(F.struct("delivery", "hit"), order).alias("own"))
        .select("own.delivery.*", F.col("own.hit.time").alias("log_time"), "own.hit.lat", "own.hit.lng")
    )


def found_pings(deliveries: DataFrame, pings: DataFrame) -> DataFrame:
    """Rows of deliveries (`delivery`) with their first position (`hit`), for each courier by their own rows.

    The position is looked for in the hour of accepting, then among the first positions of later hours. A
    delivery is one row in each step, however long its window. Positions are moved once, in narrow rows;
    the second step reads one row per courier and hour, and deliveries that need no later hour are spread
    over keys of their own there, so that a courier with very many of them is not one task's work.
    """
    position = F.struct(F.col("log_time").alias("time"), "lat", "lng").alias("first")
    positions = pings.select("user_id", F.floor(F.col("log_time") / HOUR_S).alias("hour"), position)
    accept, until = F.col("accept_time_unix"), F.col("delivery.fetch_time_unix")
    probes = deliveries.where(accept <= F.col("fetch_time_unix")).select(
        F.col("transporter_id").alias("user_id"),
        F.floor(accept / HOUR_S).alias("hour"),
        F.lit(None).cast(POSITION).alias("first"),
        F.struct(*deliveries.columns).alias("delivery"),
    )
    place = F.coalesce("first.time", "delivery.accept_time_unix")
    is_probe = F.col("delivery").isNotNull()
    # No position of the hour lies before its first one. PySpark's `lead` cannot pass over nulls, its SQL can.
    earlier = F.expr("lead(first) ignore nulls over (partition by user_id, hour order by time desc, first desc)")
    # Of an hour go on: its deliveries and its first position.
    rows = (
        _finer(probes.unionByName(positions, allowMissingColumns=True).withColumn("time", place), "user_id", "hour")
        .withColumns({"hit": _next_position("time", "hour"), "earlier": earlier})
        .where(is_probe | F.col("earlier").isNull())
    )
    # The hour of accepting is done with: the probe moves on to the next one.
    later = F.col("hour") + 1
    open_probe = F.col("hit").isNull() & (until >= later * HOUR_S)
    moved = rows.select(
        "user_id", "first", "delivery", "hit", F.when(is_probe, later).otherwise(F.col("hour")).alias("hour"),
        F.when(is_probe & ~open_probe, F.pmod(F.xxhash64("delivery"), F.lit(1024))).alias("spread"),
    )
    found = (
        _finer(moved, "user_id", "spread")
        .withColumn("next", _next_position("hour", "spread"))
        .where(is_probe)
        .select("delivery", F.when(F.col("spread").isNull(), F.col("next")).otherwise(F.col("hit")).alias("hit"))
    )
    return found.where(F.col("hit.time") <= until)


def accepted_positions(
    deliveries: DataFrame,
    pings: DataFrame,
    zone: str = WAREHOUSE_ZONE,
    rules: PickupRules = PICKUP,
) -> DataFrame:
    """Plausible deliveries with the courier's position on accepting and its distance to the shop.

    Limits apply to the position that was found first, as a delivery id may occur in several rows.
    """
    return accepted(first_pings(deliveries, pings), zone, rules)


def accepted(first: DataFrame, zone: str = WAREHOUSE_ZONE, rules: PickupRules = PICKUP) -> DataFrame:
    """`accepted_positions` of deliveries with their first position."""
    line = distance_m(F.col("supp_lng"), F.col("supp_lat"), F.col("lng"), F.col("lat"))
    return (
        first.withColumns(
            {
                "report_time": format_epoch(F.col("log_time"), zone),
                "row_num": F.lit(1).cast("long"),
                "real_time_line_distance": line,
            }
        )
        .where(plausible(rules))
        .select(
            "delivery_id",
            "transporter_id",
            "supplier_id",
            "supplier_type_id",
            "distance",
            "cargo_type_id",
            "accept_time",
            "arrive_time",
            "fetch_time",
            "finish_time",
            "a_time",
            "a1_time",
            "a2_time",
            "report_time",
            "row_num",
            "supp_lat",
            "supp_lng",
            "lat",
            "lng",
            "real_time_line_distance",
            "city_id",
        )
    )


def far_enough(first: DataFrame, rules: PickupRules = PICKUP) -> DataFrame:
    """Drop deliveries whose courier was nearer to the shop than the minimum."""
    return first.where(F.col("real_time_line_distance") >= rules.min_distance_m)
