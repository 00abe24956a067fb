"""Time columns. Wall-clock text is read in an explicit zone, never in the session's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorclock.settings import WAREHOUSE_ZONE, ZERO_DATE, ZERO_DATE_EPOCH

_EPOCH_START = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def wall_clock(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` text as a zone-less timestamp; anything else is null."""
    return F.when(F.length(text) == 19, text).try_cast("timestamp_ntz")


def _seconds_since_start(ntz: Column) -> Column:
    # A difference of zone-less timestamps does not depend on the session's zone.
    return (ntz - F.expr(_EPOCH_START)).cast("interval second").cast("long")


def parse_epoch(text: Column, zone: str = WAREHOUSE_ZONE) -> Column:
    """Unix seconds of wall-clock text; the all-zero date keeps the warehouse's own number."""
    ntz = wall_clock(text)
    if zone != "UTC":
        ntz = F.convert_timezone(F.lit(zone), F.lit("UTC"), ntz)
    return F.when(text == ZERO_DATE, F.lit(ZERO_DATE_EPOCH)).otherwise(_seconds_since_start(ntz))


def epoch_of_ntz(ntz: Column) -> Column:
    """Unix seconds of a zone-less timestamp that already is UTC."""
    return _seconds_since_start(ntz)


def _at(epoch: Column, zone: str) -> Column:
    ntz = F.timestamp_add("SECOND", epoch, F.expr(_EPOCH_START))
    return ntz if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz)


def format_epoch(epoch: Column, zone: str = WAREHOUSE_ZONE) -> Column:
    """Unix seconds as `yyyy-MM-dd HH:mm:ss` text in the zone."""
    return _at(epoch, zone).cast("string")


def date_of_epoch(epoch: Column, zone: str = WAREHOUSE_ZONE) -> Column:
    """Unix seconds as `yyyy-MM-dd` text in the zone."""
    if zone == "UTC":
        return F.date_from_unix_date(F.floor(epoch / 86400).cast("int")).cast("string")
    return _at(epoch, zone).cast("date").cast("string")


def hour_of(text: Column) -> Column:
    return F.hour(wall_clock(text))


def weekday_of(text: Column) -> Column:
    """0 = Monday."""
    return F.weekday(wall_clock(text))


def peak_class(hour: Column) -> Column:
    """1 = meal times, 2 = between them, 3 = night, 0 = the remaining hours."""
    return (
        F.when(hour.isin(11, 12, 18, 19), 1)
        .when(hour.isin(9, 10, 15, 16, 20, 21), 2)
        .when(hour.isin(*range(0, 9), 23), 3)
        .otherwise(0)
    )


def days_before(date: Column, days: int | Column) -> Column:
    """`yyyy-MM-dd` text moved back by a number of days."""
    return F.date_sub(date.cast("date"), days).cast("string")


def compact_date(date: Column, days: int | Column = 0) -> Column:
    """`yyyyMMdd` of the day that lies the given number of days back."""
    return F.replace(days_before(date, days), F.lit("-"), F.lit(""))
