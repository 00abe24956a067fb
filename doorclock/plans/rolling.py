"""History, peak and landmark libraries that roll: a run adds its days, and a window sums what days have.

A library of a window (a quarter, a month) need not read the window's deliveries, orders and positions
every day. A run reduces its own days to parts that add up: numbers and sums of phase times per owner,
and how often each duration occurred per courier or landmark. The parts of a day are replaced as a whole and kept
by day (`sources.daily`). A window's library is then exact, medians and deviations included, because it is
computed from the same counts as the full one. Nothing is subtracted: a window reads its own days.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorclock import settings as S
from doorclock.operators import geofence, history, peak, poi
from doorclock.plans import phase_c
from doorclock.plans.staging import staged
from doorclock.plans.warehouse import Warehouse
from doorclock.settings import DateRange, DwellRules
from doorclock.sources import daily, tables

OWNERS = ("supplier_id", "transporter_id")


def days_of(dates: DateRange) -> list[str]:
    first, last = date.fromisoformat(dates.first), date.fromisoformat(dates.last)
    return [(first + timedelta(days=k)).isoformat() for k in range((last - first).days + 1)]


def _widened(dates: DateRange, before: int, after: int) -> DateRange:
    first, last = date.fromisoformat(dates.first), date.fromisoformat(dates.last)
    return DateRange((first - timedelta(days=before)).isoformat(), (last + timedelta(days=after)).isoformat())


def add_deliveries(wh: Warehouse, folder: str, dates: DateRange, zone: str = S.WAREHOUSE_ZONE) -> None:
    """Replace the history parts of the given days. Only these days of the deliveries are scanned."""
    base = tables.delivery_history_base(wh.deliveries, dates, zone, ("create_dt",)).withColumnRenamed("create_dt", "day")
    for owner in OWNERS:
        daily.replace_days(history.history_parts(base, owner, "day"), f"{folder}/{owner}", days_of(dates))


def history_over(spark: SparkSession, folder: str, dates: DateRange, owner: str) -> DataFrame:
    """The window's history of an owner, as `history.delivery_history` over its deliveries."""
    return history.history_of_parts(daily.read_days(spark, f"{folder}/{owner}", dates), owner)


def history_library(spark: SparkSession, folder: str, dates: DateRange, owner: str) -> DataFrame:
    return history.single_city(history_over(spark, folder, dates, owner), owner)


def add_stays(
    wh: Warehouse,
    folder: str,
    dates: DateRange,
    zone: str = S.WAREHOUSE_ZONE,
    rules: DwellRules = S.CURRENT,
    days_before: int = 1,
    days_after: int = 1,
) -> None:
    """Replace the peak and landmark parts of the orders created on the given days.

    Positions are read from so many days before and after. An order that is delivered past midnight is
    complete once the next day's positions are there, so a daily run repeats the day before.
    """
    orders = tables.order_scan(wh.orders, dates, zone, rules.drop_sentinel_times).withColumnRenamed("create_dt", "day")
    pings = tables.ping_scan(wh.coords, _widened(dates, days_before, days_after))
    stays = staged(geofence.dwell(geofence.pings_in_circle(orders, pings, rules), orders, rules, "day"), "daily-stays")
    days = days_of(dates)
    daily.replace_days(peak.stay_counts(stays, "day"), f"{folder}/courier_stays", days)
    daily.replace_days(poi.landmark_counts(phase_c.bound(wh, stays, rules), rules, "day"), f"{folder}/landmark_stays", days)


def courier_peak_over(spark: SparkSession, folder: str, dates: DateRange, rules: DwellRules = S.CURRENT) -> DataFrame:
    """The window's courier statistics, medians exact, as `peak.courier_peak` over its stays."""
    return peak.peak_of_counts(peak.merged_counts(daily.read_days(spark, f"{folder}/courier_stays", dates)), rules)


def landmark_statistics_over(spark: SparkSession, folder: str, dates: DateRange, rules: DwellRules = S.CURRENT) -> DataFrame:
    """The window's landmark statistics, as `poi.poi_statistics` over its bound orders."""
    return poi.statistics_of_counts(poi.merged_counts(daily.read_days(spark, f"{folder}/landmark_stays", dates)), rules)


def labelled(tables_by_end: dict[str, DataFrame], name: str = "window_end") -> DataFrame:
    """Libraries of several windows below each other."""
    parts = [table.withColumn(name, F.lit(end)) for end, table in tables_by_end.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
