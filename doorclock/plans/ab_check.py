"""Daily check of the online predictions against what was measured."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock import settings as S
from doorclock.operators.errors import ab_segments, error_report
from doorclock.plans import phase_a, phase_c
from doorclock.plans.warehouse import Warehouse
from doorclock.settings import DateRange
from doorclock.sources import tables


def previous_and(day: str) -> DateRange:
    """The day of the log and the one before, in which its orders were created."""
    return DateRange(str(date.fromisoformat(day) - timedelta(days=1)), day)


def _on_order_and_courier(log: DataFrame, actual: DataFrame, order: str) -> DataFrame:
    keyed = log.withColumns(
        {
            "_order": F.col("orderid").try_cast("long"),
            "_courier": F.col("transporterid").try_cast("long"),
        }
    )
    return keyed.join(
        actual,
        (F.col("_order") == F.col(order)) & (F.col("_courier") == F.col("transporter_id")),
    )


def pickup_pairs(
    wh: Warehouse, log_dates: DateRange, order_dates: DateRange, zone: str = S.WAREHOUSE_ZONE
) -> DataFrame:
    """Predicted and measured pick-up times."""
    log = tables.pickup_log(tables.log_scan(wh.biz_log, log_dates, S.LOG_TYPE_PICKUP))
    actual = phase_a.accepted_positions(wh, order_dates, zone)
    return _on_order_and_courier(log, actual, "delivery_id").select(
        "recorderid",
        "orderid",
        "pickuptimevalue",
        "isdowngrade",
        "test_id",
        "cityid",
        "transporterid",
        "supplier_id",
        "supplier_type_id",
        "cargo_type_id",
        "accept_time",
        "arrive_time",
        "fetch_time",
        "real_time_line_distance",
        "a_time",
        "a1_time",
        "a2_time",
        "city_id",
    )


def receiver_pairs(
    wh: Warehouse, log_dates: DateRange, order_dates: DateRange, zone: str = S.WAREHOUSE_ZONE
) -> DataFrame:
    """Predicted and measured hand-over times."""
    log = tables.receiver_log(tables.log_scan(wh.biz_log, log_dates, S.LOG_TYPE_RECEIVER))
    actual = phase_c.dwell(wh, order_dates, zone, S.ONLINE_CHECK)
    return _on_order_and_courier(log, actual, "order_id").select(
        *log.columns,
        "delivery_time2",
        "delivery_time1",
        "receiver_address",
        "cargo_type_id",
        "cargo_weight",
    )


def pickup_report(pairs: DataFrame) -> DataFrame:
    return error_report(pairs, F.col("pickuptimevalue"), F.col("a2_time"), ab_segments())


def receiver_report(pairs: DataFrame) -> DataFrame:
    return error_report(pairs, F.col("receivertimevalue"), F.col("delivery_time2"), ab_segments())
