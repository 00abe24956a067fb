"""Hand-over phase: courier and landmark library, and training or validation sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock import settings as S
from doorclock.operators import geofence, peak, poi
from doorclock.plans.warehouse import Warehouse
from doorclock.schemas import HANDOVER_SAMPLE
from doorclock.settings import DateRange, DwellRules
from doorclock.sources import tables


def in_circle(
    wh: Warehouse, dates: DateRange, zone: str = S.WAREHOUSE_ZONE, rules: DwellRules = S.CURRENT
) -> tuple[DataFrame, DataFrame]:
    """Positions in the circle, narrow, and the orders they belong to."""
    orders = tables.order_scan(wh.orders, dates, zone, rules.drop_sentinel_times)
    return geofence.pings_in_circle(orders, tables.ping_scan(wh.coords, dates), rules), orders


def dwell(
    wh: Warehouse, dates: DateRange, zone: str = S.WAREHOUSE_ZONE, rules: DwellRules = S.CURRENT
) -> DataFrame:
    return geofence.dwell(*in_circle(wh, dates, zone, rules), rules)


def bound(wh: Warehouse, stays: DataFrame, rules: DwellRules = S.CURRENT) -> DataFrame:
    return poi.bind_landmarks(stays, tables.poi_scan(wh.poi_info), wh.poi_difficulty, rules)


def with_courier_history(looked_up: DataFrame, courier_history: DataFrame) -> DataFrame:
    return looked_up.join(
        courier_history.select(
            "transporter_id",
            "city_id",
            F.col("history_order_num").alias("t_history_order_num"),
            F.col("avg_a1_time").alias("t_avg_a1_time"),
            F.col("avg_a2_time").alias("t_avg_a2_time"),
        ),
        ["transporter_id", "city_id"],
    ).select(*looked_up.columns, "t_history_order_num", "t_avg_a1_time", "t_avg_a2_time")


def with_courier(looked_up: DataFrame, courier_history: DataFrame, courier_peak: DataFrame) -> DataFrame:
    """Courier history and peak in one join, so that a busy courier's rows can be split between tasks.

    Both tables have one row per courier and city; they are joined with each other first.
    """
    keys = ["transporter_id", "city_id"]
    values = [c for c in courier_peak.columns if c not in keys]
    couriers = courier_history.select(
        *keys,
        F.col("history_order_num").alias("t_history_order_num"),
        F.col("avg_a1_time").alias("t_avg_a1_time"),
        F.col("avg_a2_time").alias("t_avg_a2_time"),
    ).join(courier_peak, keys)
    added = ["t_history_order_num", "t_avg_a1_time", "t_avg_a2_time", *values]
    return looked_up.join(couriers, keys).select(*looked_up.columns, *added)


def sample(
    bound_rows: DataFrame,
    statistics: DataFrame,
    courier_history: DataFrame,
    courier_peak: DataFrame,
    rules: DwellRules = S.CURRENT,
) -> DataFrame:
    """The hand-over sample, columns in file order (older rules give their own columns)."""
    rows = with_courier(poi.landmark_lookup(bound_rows, statistics), courier_history, courier_peak)
    return rows.select(*HANDOVER_SAMPLE) if rules.peak_on == "delivery_time2" else rows


def first_generation_sample(
    wh: Warehouse,
    stays: DataFrame,
    courier_history: DataFrame,
    rules: DwellRules = S.FIRST_GENERATION,
) -> DataFrame:
    """The older sample: landmark and peak statistics come from the sample's own rows.

    Peak rows are built after the landmark and history joins, so they describe only couriers and
    orders that reached the sample.
    """
    bound_rows = bound(wh, stays, rules)
    statistics = poi.poi_statistics(bound_rows, rules)
    rows = with_courier_history(poi.landmark_lookup(bound_rows, statistics), courier_history)
    keys = ["transporter_id", "city_id"]
    values = peak.courier_peak(rows, rules)
    return rows.join(values, keys).select(*rows.columns, *[c for c in values.columns if c not in keys])
