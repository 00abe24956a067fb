"""Pick-up phase: history library and training or validation sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock import settings as S
from doorclock.functions.geo import geohash7
from doorclock.operators import first_ping, history
from doorclock.plans.warehouse import Warehouse
from doorclock.schemas import PICKUP_SAMPLE
from doorclock.settings import DateRange, PickupRules
from doorclock.sources import tables


def history_library(
    wh: Warehouse, dates: DateRange, owner: str, zone: str = S.WAREHOUSE_ZONE
) -> DataFrame:
    """History of `supplier_id` or `transporter_id`, without owners in several cities."""
    base = tables.delivery_history_base(wh.deliveries, dates, zone)
    return history.single_city(history.delivery_history(base, owner), owner)


def enriched_deliveries(
    wh: Warehouse, dates: DateRange, zone: str = S.WAREHOUSE_ZONE
) -> DataFrame:
    return first_ping.supplier_enriched(
        tables.delivery_scan(wh.deliveries, dates, zone), tables.supplier_scan(wh.suppliers)
    )


def accepted_positions(
    wh: Warehouse,
    dates: DateRange,
    zone: str = S.WAREHOUSE_ZONE,
    rules: PickupRules = S.PICKUP,
) -> DataFrame:
    """Plausible deliveries with the courier's position on accepting."""
    return first_ping.accepted_positions(
        enriched_deliveries(wh, dates, zone),
        tables.ping_scan(wh.coords, dates, positive_only=True),
        zone,
        rules,
    )


def sample(
    wh: Warehouse,
    dates: DateRange,
    courier_history: DataFrame,
    supplier_history: DataFrame,
    zone: str = S.WAREHOUSE_ZONE,
    rules: PickupRules = S.PICKUP,
) -> DataFrame:
    """The pick-up sample, columns in file order."""

    def prefixed(table: DataFrame, owner: str, prefix: str) -> DataFrame:
        values = ["history_order_num", "avg_a1_time", "avg_a2_time"]
        return table.select(
            owner, "city_id", *[F.col(c).alias(f"{prefix}_{c}") for c in values]
        )

    weights = wh.orders.select(F.col("order_id").alias("delivery_id"), "cargo_weight")
    near = first_ping.far_enough(accepted_positions(wh, dates, zone, rules), rules)
    return (
        near.withColumns(
            {
                "s_geohash": geohash7(F.col("supp_lng"), F.col("supp_lat")),
                "t_geohash": geohash7(F.col("lng"), F.col("lat")),
            }
        )
        .join(weights, "delivery_id")
        .join(prefixed(courier_history, "transporter_id", "t"), ["transporter_id", "city_id"])
        .join(prefixed(supplier_history, "supplier_id", "s"), ["supplier_id", "city_id"])
        .select(*PICKUP_SAMPLE)
    )
