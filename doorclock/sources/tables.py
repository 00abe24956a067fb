"""Scans of the warehouse tables. Date filters come first, so partition pruning applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorclock import settings as S
from doorclock.functions.geo import distance_m
from doorclock.functions.text import json_field
from doorclock.functions.times import parse_epoch
from doorclock.settings import DateRange


def _in_range(column: str, dates: DateRange) -> Column:
    return F.col(column).between(dates.first, dates.last)


def _once(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows with more columns. Through a one-row generator: a filter on one reads it, and does not parse the text again."""
    return rows.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in values.items()]))))


def order_scan(
    orders: DataFrame,
    dates: DateRange,
    zone: str = S.WAREHOUSE_ZONE,
    drop_sentinel_times: bool = True,
) -> DataFrame:
    """Completed orders with their fetch and finish times, one row per order."""
    rows = orders.where(
        _in_range("create_dt", dates)
        & (F.col("order_status") == S.COMPLETED)
        & (F.col("order_source_from") != S.EXCLUDED_SOURCE)
    )
    rows = _once(rows, {f"{c}_unix": parse_epoch(F.col(c), zone) for c in ("fetch_time", "finish_time")})
    fetch, finish = F.col("fetch_time_unix"), F.col("finish_time_unix")
    if drop_sentinel_times:
        rows = rows.where((finish != S.UNSET_TIME_EPOCH) & (fetch != S.UNSET_TIME_EPOCH))
    return rows.select(
        "order_id",
        "transporter_id",
        "supplier_id",
        "receiver_id",
        "fetch_time_unix",
        "finish_time_unix",
        (finish - fetch).alias("bc_time"),
        "fetch_time",
        "finish_time",
        F.col("receiver_lat").alias("r_lat"),
        F.col("receiver_lng").alias("r_lng"),
        distance_m(
            F.col("receiver_lng"), F.col("receiver_lat"), F.col("supplier_lng"), F.col("supplier_lat")
        ).alias("s_r_line_distance"),
        "receiver_address",
        "cargo_type_id",
        "cargo_weight",
        "cargo_amt",
        "tips_amt",
        "allowance_amt",
        "city_id",
        "create_dt",
    )


def with_phase_durations(deliveries: DataFrame, zone: str = S.WAREHOUSE_ZONE) -> DataFrame:
    """Unix times of a delivery and the seconds between accept, arrival and fetch."""
    return _once(
        deliveries, {f"{p}_time_unix": parse_epoch(F.col(f"{p}_time"), zone) for p in ("accept", "arrive", "fetch", "finish")}
    ).withColumns(
        {
            "a_time": F.col("fetch_time_unix") - F.col("accept_time_unix"),
            "a1_time": F.col("arrive_time_unix") - F.col("accept_time_unix"),
            "a2_time": F.col("fetch_time_unix") - F.col("arrive_time_unix"),
        }
    )


def _business_deliveries(deliveries: DataFrame, dates: DateRange) -> DataFrame:
    return deliveries.where(
        _in_range("create_dt", dates)
        & (F.col("distance") > 0)
        & (F.col("delivery_status") == S.COMPLETED)
        & (F.col("supplier_type_id") != S.CONSUMER_SHOP_TYPE)
    )


def delivery_scan(
    deliveries: DataFrame, dates: DateRange, zone: str = S.WAREHOUSE_ZONE
) -> DataFrame:
    """Completed deliveries of shops whose arrival and fetch were reported."""
    return (
        with_phase_durations(_business_deliveries(deliveries, dates), zone)
        .where(
            (F.col("arrive_time_unix") != S.ZERO_DATE_EPOCH)
            & (F.col("fetch_time_unix") != S.ZERO_DATE_EPOCH)
        )
        .select(
            "delivery_id",
            "transporter_id",
            "supplier_id",
            "distance",
            "cargo_type_id",
            "accept_time",
            "accept_time_unix",
            "arrive_time",
            "arrive_time_unix",
            "fetch_time",
            "fetch_time_unix",
            "finish_time",
            "finish_time_unix",
            "city_id",
            "a_time",
            "a1_time",
            "a2_time",
        )
    )


def delivery_history_base(
    deliveries: DataFrame, dates: DateRange, zone: str = S.WAREHOUSE_ZONE, also: tuple[str, ...] = ()
) -> DataFrame:
    """Deliveries over the longer range that the history tables describe."""
    return (
        with_phase_durations(
            _business_deliveries(deliveries, dates).where(
                F.col("delivery_source_from") != S.EXCLUDED_SOURCE
            ),
            zone,
        )
        .where(
            (F.col("arrive_time_unix") > S.HISTORY_MIN_EPOCH)
            & (F.col("fetch_time_unix") > S.HISTORY_MIN_EPOCH)
        )
        .select(
            "delivery_id",
            "supplier_id",
            "transporter_id",
            "accept_time",
            "city_id",
            "a2_time",
            "a1_time",
            "a_time",
            *also,
        )
    )


def ping_scan(coords: DataFrame, dates: DateRange, positive_only: bool = False) -> DataFrame:
    """Courier positions; the pick-up phase leaves out positions without coordinates."""
    rows = coords.where(_in_range("log_dt", dates))
    if positive_only:
        rows = rows.where((F.col("lat") > 0) & (F.col("lng") > 0))
    return rows.select("user_id", "lat", "lng", F.col("logging_unixtime").alias("log_time"))


def supplier_scan(suppliers: DataFrame) -> DataFrame:
    """Shops with a position."""
    return suppliers.where(
        (F.col("supplier_type_id") != S.CONSUMER_SHOP_TYPE)
        & (F.col("supplier_lat") > 0)
        & (F.col("supplier_lng") > 0)
    ).select("supplier_id", "supplier_lat", "supplier_lng", "supplier_type_id")


def poi_scan(poi_info: DataFrame) -> DataFrame:
    """Named landmarks of the kind orders are bound to."""
    return poi_info.where(
        F.col("poi_name").isNotNull() & (F.col("poi_type") == S.LANDMARK_TYPE)
    ).select("lng", "lat", "poi_name", "poi_id", "distance", "poi_lat", "poi_lng")


def log_scan(log: DataFrame, dates: DateRange, biz_type: int) -> DataFrame:
    """JSON rows of one business type; the daily job passes a range of one day."""
    return log.where(_in_range("dt", dates) & (F.col("biz_type") == biz_type))


def _prediction_log(rows: DataFrame, value_field: str, fields: list[str]) -> DataFrame:
    """Log fields under lower-case names; a predicted value that is no number becomes null."""
    value = json_field(F.col("data"), value_field).try_cast("int")
    return rows.select(
        value.alias(value_field.lower()),
        *[json_field(F.col("data"), f).alias(f.lower()) for f in fields],
    )


_LOG_FIELDS = ["recOrderId", "orderId", "isDowngrade", "test_id", "cityId", "transporterId", "now_timestamp"]


def pickup_log(rows: DataFrame) -> DataFrame:
    return _prediction_log(rows, "pickupTimeValue", [*_LOG_FIELDS, "supplierLat"])


def receiver_log(rows: DataFrame) -> DataFrame:
    return _prediction_log(rows, "receiverTimeValue", _LOG_FIELDS)


def probability_log(rows: DataFrame) -> DataFrame:
    """Probability log with its nested `dynamic_info` fields."""

    def nested(name: str) -> Column:
        return json_field(F.col("data"), "dynamic_info", name).alias(name)

    return rows.select(
        json_field(F.col("data"), "order_id").alias("order_id"),
        json_field(F.col("data"), "prob").alias("prob"),
        nested("time_window_key"),
        nested("overtime_allowance"),
        nested("tips"),
        nested("allowance"),
    )
