"""Courier statistics by time-of-day class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorclock.functions.times import hour_of, peak_class
from doorclock.schemas import COURIER_PEAK
from doorclock.settings import CURRENT, DwellRules

CLASSES = (1, 2, 3, 0)


def with_peak_class(dwell: DataFrame) -> DataFrame:
    hour = hour_of(F.col("finish_time"))
    return dwell.withColumns({"finish_hour": hour, "peek_time": peak_class(hour)})


# Stays are counted per distinct duration first; that aggregation hashes and combines before the
# shuffle. Means and medians then read far fewer rows, each with its number of stays.
_STAYS = "_stays"


def _whole_mean(value: Column) -> Column:
    n = F.sum(F.when(value.isNotNull(), F.col(_STAYS)))
    return F.try_divide(F.sum(value * F.col(_STAYS)).cast("double"), n).cast("int")


def _median(value: Column) -> Column:
    return F.percentile(value, 0.5, F.col(_STAYS))


STAY_KEYS = ["transporter_id", "city_id", "peek_time", "delivery_time1", "delivery_time2"]


def stay_counts(dwell: DataFrame, *also: str) -> DataFrame:
    """How many stays of a courier, city and class have the same durations, and the same `also` columns.

    Counts of disjoint sets of stays, as of days, add up: the statistics of any window are exact.
    """
    return with_peak_class(dwell).groupBy(*also, *STAY_KEYS).agg(F.count(F.lit(1)).alias(_STAYS))


def courier_peak(dwell: DataFrame, rules: DwellRules = CURRENT) -> DataFrame:
    """Stays per (courier, city): overall, and counts and typical time per class.

    The per-class time is the integer mean, or the exact median when the rules ask for it.
    """
    return peak_of_counts(stay_counts(dwell), rules)


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of several days or runs as one."""
    return counts.groupBy(*STAY_KEYS).agg(F.sum(_STAYS).alias(_STAYS))


def peak_of_counts(counts: DataFrame, rules: DwellRules = CURRENT) -> DataFrame:
    stay = F.col(rules.peak_on)
    names = {
        c: f"per_delivery_time1_peek{c}"
        if rules.peak_on == "delivery_time1"
        else f"per_delivery_time_peek{c}"
        for c in CLASSES
    }
    typical = _median if rules.peak_median else _whole_mean
    in_class = {c: F.col("peek_time") == c for c in CLASSES}
    first_generation = [
        _whole_mean(F.col("delivery_time1")).alias("avg_delivery_time1"),
        _median(F.col("delivery_time1")).alias("per_delivery_time1"),
    ]
    return counts.groupBy("transporter_id", "city_id").agg(
        F.sum(_STAYS).alias("delivery_cnt"),
        *(first_generation if rules.peak_on == "delivery_time1" else []),
        _whole_mean(F.col("delivery_time2")).alias("avg_delivery_time2"),
        _median(F.col("delivery_time2")).alias("per_delivery_time2"),
        *[F.coalesce(F.sum(F.when(in_class[c], F.col(_STAYS))), F.lit(0).cast("long")).alias(f"cnt_peek{c}") for c in CLASSES],
        *[typical(F.when(in_class[c], stay)).alias(names[c]) for c in CLASSES],
    )


def published_peak(peak: DataFrame, run_time: str) -> DataFrame:
    """Peak rows aligned with the online table: what the job does not compute is -1."""
    known = ["transporter_id", "city_id"]
    values = [c for c in COURIER_PEAK if c not in ("id", "create_time", "update_time", *known)]

    return peak.select(
        F.xxhash64(*known).alias("id"),
        *known,
        *[(F.col(c) if c in peak.columns else F.lit(-1)).alias(c) for c in values],
        F.lit(run_time).alias("create_time"),
        F.lit(run_time).alias("update_time"),
    )
