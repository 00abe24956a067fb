"""Feature rows of the samples. Rows with a field that cannot be read are dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructField

from doorclock import settings as S
from doorclock.functions.scaling import number, scaled, whole
from doorclock.functions.times import hour_of, peak_class, weekday_of
from doorclock.operators.binary import class_label

HANDOVER_CATEGORIES = ["cargo_type_id", "city_id", "hour"]
_HANDOVER_REALS = [
    "cargo_weight",
    "percentile_delivery_time_poi",
    "avg_delivery_time_poi",
    "percentile_distance_poi",
    "std_distance_poi",
    "std_delivery_time_poi",
    "order_cnt",
    "t_history_order_num",
    "t_avg_a1_time",
    "t_avg_a2_time",
]
_HANDOVER_WHOLES = [
    "delivery_cnt",
    "avg_delivery_time2",
    "per_delivery_time2",
    "cnt_peek1",
    "cnt_peek2",
    "cnt_peek3",
    "cnt_peek0",
    "per_delivery_time_peek1",
    "per_delivery_time_peek2",
    "per_delivery_time_peek3",
    "per_delivery_time_peek0",
]
_HANDOVER_CURRENT = ["current_cnt_peek", "current_per_delivery_time_peek"]
HANDOVER_NUMBERS = _HANDOVER_REALS + _HANDOVER_WHOLES + _HANDOVER_CURRENT

PICKUP_CATEGORIES = [
    "cargo_type_id",
    "city_id",
    "hour",
    "weekday",
    "is_weekend",
    "is_over200m",
    "is_over20m",
]
_PICKUP_REALS = [
    "real_time_line_distance",
    "t_history_order_num",
    "t_avg_a1_time",
    "t_avg_a2_time",
    "s_history_order_num",
    "s_avg_a1_time",
    "s_avg_a2_time",
    "cargo_weight",
]
PICKUP_NUMBERS = [*_PICKUP_REALS, "old_a1", "old_a2"]

RATING_CATEGORIES = ["grade", "work_dt_cnt", "not_first_invalid"]
RATING_NUMBERS = ["score", "avg_dis", "avg_speed", "score/avg_speed", "grade/avg_speed"]


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns]))


def _missing_as_flag(field: StructField) -> Column:
    """Missing values of a table sample read as -1, as they do in a text sample; numbers stay numbers."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, NumericType):
        return F.coalesce(value, F.lit(-1).cast(field.dataType))
    return F.coalesce(value.cast("string"), F.lit("-1"))


def with_null_flags(sample: DataFrame) -> DataFrame:
    """A table sample with its nulls marked, so it gives the rows its text export gives."""
    return sample.select(*[_missing_as_flag(f).alias(f.name) for f in sample.schema])


def city_speed(city: Column) -> Column:
    """Mean courier speed in the city, or the general one for a city without its own."""
    pairs = [F.lit(x) for item in S.CITY_SPEED_M_S.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), city), F.lit(S.DEFAULT_SPEED_M_S))


def current_class_value(prefix: str, klass: Column) -> Column:
    """The value of the class the order's hour falls into."""
    return (
        F.when(klass == 1, F.col(f"{prefix}1"))
        .when(klass == 2, F.col(f"{prefix}2"))
        .when(klass == 3, F.col(f"{prefix}3"))
        .otherwise(F.col(f"{prefix}0"))
    )


def handover_features(sample: DataFrame) -> DataFrame:
    """Features and label (seconds in the circle, above 0) of the hand-over sample."""
    hour = hour_of(F.col("finish_time").cast("string"))
    rows = sample.select(
        F.col("order_id").cast("string").alias("order_id"),
        *[F.col(c).cast("string").alias(c) for c in HANDOVER_CATEGORIES if c != "hour"],
        hour.cast("string").alias("hour"),
        peak_class(hour).alias("_class"),
        *[number(F.col(c)).alias(c) for c in _HANDOVER_REALS],
        *[whole(F.col(c)).alias(c) for c in _HANDOVER_WHOLES],
        number(F.col("delivery_time2")).alias("label"),
    )
    return (
        _complete(rows, [*HANDOVER_CATEGORIES, *_HANDOVER_REALS, *_HANDOVER_WHOLES])
        .where(F.col("label") > 0)
        .withColumns(
            {
                "current_cnt_peek": current_class_value("cnt_peek", F.col("_class")),
                "current_per_delivery_time_peek": current_class_value(
                    "per_delivery_time_peek", F.col("_class")
                ),
            }
        )
        .select("order_id", *HANDOVER_CATEGORIES, *HANDOVER_NUMBERS, "label")
    )


def baseline_estimates(distance: Column, city: Column, supplier_mean_a2: Column) -> dict[str, Column]:
    """The rule-based estimates: riding time at the city's speed, and the shop's mean wait."""
    return {"old_a1": distance / city_speed(city.cast("int")), "old_a2": supplier_mean_a2}


def pickup_features(sample: DataFrame) -> DataFrame:
    """Features, rule-based estimates and both labels (above 0) of the pick-up sample."""
    finish = F.col("finish_time").cast("string")
    weekday = weekday_of(finish)
    distance = number(F.col("real_time_line_distance"))

    def flag(test: Column) -> Column:
        return F.when(test, "1").otherwise("0")

    rows = sample.select(
        F.col("delivery_id").cast("string").alias("delivery_id"),
        F.col("cargo_type_id").cast("string").alias("cargo_type_id"),
        F.col("city_id").cast("string").alias("city_id"),
        F.col("city_id").try_cast("int").alias("_city"),
        hour_of(finish).cast("string").alias("hour"),
        weekday.cast("string").alias("weekday"),
        flag(weekday > 4).alias("is_weekend"),
        flag(distance > 200).alias("is_over200m"),
        flag(distance > 20).alias("is_over20m"),
        *[number(F.col(c)).alias(c) for c in _PICKUP_REALS],
        number(F.col("a1_time")).alias("label_a1"),
        number(F.col("a2_time")).alias("label_a2"),
    )
    estimates = baseline_estimates(
        F.col("real_time_line_distance"), F.col("_city"), F.col("s_avg_a2_time")
    )
    return (
        _complete(rows, ["_city", *PICKUP_CATEGORIES, *_PICKUP_REALS])
        .where((F.col("label_a1") > 0) & (F.col("label_a2") > 0))
        .withColumns(estimates)
        .select("delivery_id", *PICKUP_CATEGORIES, *PICKUP_NUMBERS, "label_a1", "label_a2")
    )


def rating_features(sample: DataFrame, scale: bool = True) -> DataFrame:
    """Scaled features and class label of the courier-rating sample."""
    score, grade, speed = (number(F.col(c)) for c in ("score", "grade", "avg_speed"))
    values = {
        "score": score,
        "avg_dis": number(F.col("avg_dis")),
        "avg_speed": speed,
        "score/avg_speed": F.try_divide(score, speed),
        "grade/avg_speed": F.try_divide(grade, speed),
    }
    rows = sample.select(
        "transporter_id",
        *[F.col(c).cast("string").alias(c) for c in RATING_CATEGORIES],
        *[(scaled(n, v) if scale else v).alias(n) for n, v in values.items()],
        class_label(F.col("invalid_label").cast("string")).alias("label"),
    )
    return _complete(rows, [*RATING_CATEGORIES, *RATING_NUMBERS, "label"])


def crossed(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Add a category for each pair of categories (none are crossed by default)."""
    return df.withColumns(
        {f"{a}_{b}": F.concat_ws("_", F.col(a), F.col(b)) for a, b in pairs.items()}
    )
