"""The libraries of both phases, written once, with the counts of every step taken as they are written.

Positions are by far the largest table, and those of a courier meet that courier's orders only. So they are moved for
some of the couriers at a time, and what a share of them left on the executors' disks goes before the next one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock import settings as S
from doorclock.operators import audit, first_ping, geofence, history, peak, poi
from doorclock.plans import phase_a, phase_c
from doorclock.plans.staging import dropped, released, staged
from doorclock.plans.warehouse import Warehouse
from doorclock.settings import DateRange
from doorclock.sources import tables

#: Shares of the couriers whose positions are moved one after the other.
SHARES = 4


@dataclass(frozen=True)
class Libraries:
    dwell: DataFrame
    courier_peak: DataFrame
    bound: DataFrame
    statistics: DataFrame
    accepted: DataFrame
    histories: dict[str, DataFrame]
    funnel: DataFrame


def _written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    rows, taken = audit.observed(df, {"rows": F.count(F.lit(1))})
    table = staged(rows, name)
    return table, taken.get["rows"]


def _shares(rows: DataFrame, pings: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The orders or deliveries of every `SHARES`-th courier, and the same couriers' positions."""
    same = rows.schema["transporter_id"].dataType == pings.schema["user_id"].dataType

    def of(df: DataFrame, courier: str, k: int) -> DataFrame:
        # Equal as numbers or as texts, ids of different types are equal as doubles or have none.
        value = F.col(courier) if same else F.col(courier).try_cast("double")
        return df.where(F.pmod(F.xxhash64(value), F.lit(SHARES)) == k)

    for k in range(SHARES):
        yield of(rows, "transporter_id", k), of(pings, "user_id", k)


def _stays(wh: Warehouse, dates: DateRange, zone: str) -> tuple[DataFrame, dict[str, int]]:
    """Stays, written, and the numbers of the hand-over steps."""
    parts, total = [], Counter()
    for orders, pings in _shares(tables.order_scan(wh.orders, dates, zone), tables.ping_scan(wh.coords, dates)):
        rows, seen = audit.observed(geofence.stays(geofence.pings_in_circle(orders, pings), orders), audit.handover_metrics())
        parts.append(staged(rows, "stays"))
        total.update(seen.get)
        del rows, seen
        released(wh.orders.sparkSession)
    return reduce(DataFrame.unionByName, parts), total


def _found(wh: Warehouse, dates: DateRange, zone: str) -> DataFrame:
    """Deliveries with their first positions, written. A delivery id may still occur for several couriers."""
    parts = []
    for deliveries, pings in _shares(phase_a.enriched_deliveries(wh, dates, zone), tables.ping_scan(wh.coords, dates, positive_only=True)):
        parts.append(staged(first_ping.found_pings(deliveries, pings), "first-positions"))
        released(wh.orders.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def _keys(table: DataFrame, key: str) -> int:
    """Distinct keys of a written table: one narrow column is read."""
    return table.select(F.count_distinct(key)).first()[0]


def libraries(wh: Warehouse, dates: DateRange, zone: str = S.WAREHOUSE_ZONE) -> Libraries:
    """Every library, each fact table scanned once per phase that reads it, and the funnel of counts.

    The history of shops and that of couriers are sums of the same parts, so deliveries are scanned once for both.
    """
    spark = wh.orders.sparkSession
    stays, found = _stays(wh, dates, zone)
    counts = audit.metric_pairs(found, ["c1_in_circle", "c2_overdwell", "c3_not_overdwell", "c4_dwell"])
    dwell = stays.where(geofence.not_overdwell() & geofence.valid_stay()).drop("finish_time_unix")
    peaks, n = _written(peak.courier_peak(dwell), "courier-peak")
    counts["c5_courier_peak"] = n, _keys(peaks, "transporter_id")
    bound, n = _written(phase_c.bound(wh, dwell), "bound")
    counts["c6_bound"] = n, _keys(bound, "order_id")
    statistics, n = _written(poi.poi_statistics(bound), "landmark-statistics")
    counts["c7_statistics"] = n, _keys(statistics, "poi_id")
    positions = _found(wh, dates, zone)
    accepted, n = _written(first_ping.accepted(first_ping.earliest(positions), zone), "accepted")
    dropped(positions)
    released(spark)
    counts["a1_accepted"] = n, n  # one row per delivery id

    base = tables.delivery_history_base(wh.deliveries, dates, zone)
    parts = staged(history.history_parts(base, "supplier_id", "transporter_id"), "history-parts")
    histories = {}
    for owner, name in (("supplier_id", "supplier"), ("transporter_id", "courier")):
        merged = history.history_of_parts(parts, owner)
        single, seen = history.single_city_observed(merged, owner)
        histories[owner] = staged(single, f"{name}-history")
        found = seen.get
        counts[f"{name}_history"] = found["rows"], found["owners"]
        counts[f"{name}_single_city"] = found["single"], found["single"]
    return Libraries(dwell, peaks, bound, statistics, accepted, histories, audit.observed_funnel(spark, counts))
