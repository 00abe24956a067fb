"""Landmarks: binding orders to them and what history says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorclock.functions.geo import point_key
from doorclock.operators.moments import deviation, squared_distances, with_group_mean
from doorclock.settings import CURRENT, DwellRules


def bind_landmarks(
    dwell: DataFrame, pois: DataFrame, difficulty: DataFrame, rules: DwellRules = CURRENT
) -> DataFrame:
    """Orders with the landmarks at their receiver's point (five decimals).

    Points compare as whole numbers. Two landmarks on one point give two rows, as they should.
    """
    long_enough = (F.col("point_cnt") > rules.bind_min_points) & (
        F.col(rules.bind_on) > rules.bind_min_s
    )
    orders = dwell.where(long_enough).withColumns(
        {"_x": point_key(F.col("r_lng")), "_y": point_key(F.col("r_lat"))}
    )
    landmarks = pois.select(
        point_key(F.col("lng")).alias("_x"),
        point_key(F.col("lat")).alias("_y"),
        "poi_id",
        "poi_name",
        "distance",
        "poi_lat",
        "poi_lng",
    )
    hard = difficulty.select("poi_id", F.lit(True).alias("_listed"), "difficulty")
    # Difficulty belongs to the landmark: attached to the small side before the orders join it.
    described = (
        landmarks.join(hard, "poi_id", "left")
        .withColumns(
            {
                "is_hard_poi": F.when(F.col("_listed"), 1).otherwise(0),
                "difficulty": F.coalesce("difficulty", F.lit(0)),
            }
        )
        .drop("_listed")
    )
    return orders.join(described, ["_x", "_y"]).select(
        *dwell.columns,
        "poi_id",
        "poi_name",
        "distance",
        "poi_lat",
        "poi_lng",
        "is_hard_poi",
        "difficulty",
    )


LANDMARK_KEYS = ["poi_id", "city_id", "poi_lat", "poi_lng"]


def landmark_counts(bound: DataFrame, rules: DwellRules = CURRENT, *also: str) -> DataFrame:
    """How many rows of a landmark and city have the same stay and distance, and the same `also` columns.

    Counts of disjoint sets of orders, as of days, add up: the statistics of any window are exact.
    """
    return bound.groupBy(*also, *LANDMARK_KEYS, "distance", F.col(rules.stats_on).alias("_stay")).agg(
        F.count(F.lit(1)).alias("_n"), F.count("order_id").alias("_orders")
    )


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of several days or runs as one."""
    return counts.groupBy(*LANDMARK_KEYS, "distance", "_stay").agg(F.sum("_n").alias("_n"), F.sum("_orders").alias("_orders"))


def poi_statistics(bound: DataFrame, rules: DwellRules = CURRENT) -> DataFrame:
    """Typical stay and distance per landmark and city, for landmarks with enough orders.

    Orders are counted per distinct stay and distance first; that aggregation hashes and combines
    before the shuffle. The statistics then read far fewer rows, each with its number of orders.
    """
    return statistics_of_counts(landmark_counts(bound, rules), rules)


def statistics_of_counts(counts: DataFrame, rules: DwellRules = CURRENT) -> DataFrame:
    n, distance, seconds = F.col("_n"), F.col("distance"), F.col("_stay")

    def weight(value: Column) -> Column:
        return F.sum(F.when(value.isNotNull(), n))

    counts = with_group_mean(counts, LANDMARK_KEYS, "_n", "distance", "_mean_distance")
    counts = with_group_mean(counts, LANDMARK_KEYS, "_n", "_stay", "_mean_stay")
    return (
        counts.groupBy(*LANDMARK_KEYS)
        .agg(
            F.percentile(seconds.cast("int"), 0.5, n).alias("percentile_delivery_time_poi"),
            F.round(F.sum(seconds * n).cast("double") / weight(seconds), 1).alias("avg_delivery_time_poi"),
            F.percentile(distance.cast("int"), 0.5, n).alias("percentile_distance_poi"),
            deviation(weight(distance), squared_distances("_n", "distance", "_mean_distance")).alias("std_distance_poi"),
            deviation(weight(seconds), squared_distances("_n", "_stay", "_mean_stay")).alias("std_delivery_time_poi"),
            F.sum("_orders").alias("order_cnt"),
        )
        .where(F.col("order_cnt") >= rules.poi_min_orders)
    )


def published_statistics(statistics: DataFrame, run_time: str) -> DataFrame:
    return statistics.select(
        F.xxhash64("poi_id", "city_id", "poi_lat", "poi_lng").alias("id"),
        *statistics.columns,
        F.lit(run_time).alias("create_time"),
        F.lit(run_time).alias("update_time"),
    )


def landmark_lookup(bound: DataFrame, statistics: DataFrame) -> DataFrame:
    """Orders with the statistics of their landmark and how far its median is off."""
    key = ["poi_id", "city_id", "poi_lat", "poi_lng"]
    median = F.col("percentile_delivery_time_poi")
    return bound.join(statistics, key).select(
        "order_id",
        "supplier_id",
        "transporter_id",
        "receiver_id",
        "s_r_line_distance",
        "finish_time",
        "receiver_address",
        "cargo_type_id",
        "cargo_weight",
        "r_lng",
        "r_lat",
        "poi_id",
        "poi_lat",
        "poi_lng",
        "is_hard_poi",
        "difficulty",
        F.col("distance").alias("receiver_poi_distance"),
        "percentile_delivery_time_poi",
        "avg_delivery_time_poi",
        "percentile_distance_poi",
        "std_distance_poi",
        "std_delivery_time_poi",
        "order_cnt",
        "city_id",
        "delivery_time1",
        "delivery_time2",
        F.abs(median - F.col("delivery_time1")).alias("error1"),
        F.abs(median - F.col("delivery_time2")).alias("error2"),
    )
