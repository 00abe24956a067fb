"""Error reports of predicted against measured times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.67, 0.8, 0.95)
LARGE_ERRORS = (0.3, 0.5, 0.7)
_STEPS_PER_E = 65536.0
_STEPS_OF_BLOCK = 1024


def _by_segment(df: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """One row per segment a row belongs to (segments may overlap)."""
    labels = F.array_compact(
        F.array(*[F.when(test, F.lit(label)) for label, test in segments.items()])
    )
    return df.withColumn("segment", F.explode(labels))


def _percentiles(values: DataFrame, histogram: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """Exact, linearly interpolated percentiles of `value` per segment.

    `histogram` counts rows per (segment, step), where a step is a fixed narrow band of values, so
    its size is bounded by the number of bands. Bands are summed to a few thousand blocks first, so
    that no task orders all bands of a segment. They tell which bands hold the wanted ranks; only the
    values in those few bands are then ordered, equal values counted together first.
    """
    coarse = F.floor(F.col("step") / _STEPS_OF_BLOCK)
    everything = Window.partitionBy("segment")
    earlier = everything.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = histogram.groupBy("segment", coarse.alias("block")).agg(F.sum("n").alias("n"))
    blocks = blocks.select(
        "segment", "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("n").over(everything).alias("total"),
    )
    so_far = Window.partitionBy("segment", "block").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = F.col("_offset") + F.sum("n").over(so_far)
    placed = histogram.withColumn("block", coarse).join(blocks, ["segment", "block"]).select(
        "segment", "step", (through - F.col("n")).alias("before"), through.alias("through"), "total"
    )

    def ranks(p: float) -> tuple[Column, Column, Column]:
        position = F.lit(p) * (F.col("total") - 1)
        return F.floor(position), F.ceil(position), position - F.floor(position)

    def holds(rank: Column) -> Column:
        return (rank >= F.col("before")) & (rank < F.col("through"))

    wanted = reduce(
        lambda a, b: a | b, [holds(ranks(p)[0]) | holds(ranks(p)[1]) for p in probs]
    )
    # At most two bands per percentile and segment, and segments are a fixed list: always tiny.
    bands = F.broadcast(placed.where(wanted).select("segment", "step", "before", "total"))
    counted = (
        values.join(bands, ["segment", "step"])
        .groupBy("segment", "step", "before", "total", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_band = (
        Window.partitionBy("segment", "step")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordered = counted.withColumn("through", F.col("before") + F.sum("n").over(in_band)).withColumn(
        "before", F.col("through") - F.col("n")
    )

    def percentile(p: float) -> Column:
        low, high, part = ranks(p)
        at_low = F.max(F.when(holds(low), F.col("value")))
        at_high = F.max(F.when(holds(high), F.col("value")))
        return at_low + (at_high - at_low) * F.max(part)

    return ordered.groupBy("segment").agg(
        *[percentile(p).alias(f"p{round(p * 100)}") for p in probs]
    )


def _stepped(value: Column) -> Column:
    # Bands of 1/65536 on a logarithmic scale, mirrored for negative values: values up to a billion
    # fall into 1.4 million bands on either side of 0. A negative value's band is rounded towards it.
    band = F.log1p(F.abs(value)) * _STEPS_PER_E
    return F.when(value < 0, -F.ceil(band)).otherwise(F.floor(band))


def percentiles_by(
    df: DataFrame, segment: Column, value: Column, probs: tuple[float, ...] = PERCENTILES, with_counts: bool = False
) -> DataFrame:
    """Percentiles of a value per segment, of which there are few; null and NaN do not count."""
    values = (
        df.select(segment.alias("segment"), value.cast("double").alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("step", _stepped(F.col("value")))
    )
    histogram = values.groupBy("segment", "step").agg(F.count(F.lit(1)).alias("n"))
    found = _percentiles(values, histogram, probs)
    if not with_counts:
        return found
    return found.join(histogram.groupBy("segment").agg(F.sum("n").alias("n")), "segment")


def exact_percentiles(
    df: DataFrame,
    value: Column,
    probs: tuple[float, ...] = PERCENTILES,
    segments: dict[str, Column] | None = None,
) -> DataFrame:
    """Percentiles of a value, overall or for a fixed list of segments; null and NaN do not count."""
    return percentiles_by(_by_segment(df, segments or {"all": F.lit(True)}), F.col("segment"), value, probs)


def error_report(
    df: DataFrame, predicted: Column, measured: Column, segments: dict[str, Column] | None = None
) -> DataFrame:
    """Absolute-error percentiles, mean error, mean relative error and shares of large errors.

    Rows without a prediction or a measurement count in `n_missing` alone. A measurement of zero has
    no relative error; it counts in `n` and `n_zero_truth`, and the relative figures leave it out.
    """
    error = F.abs(predicted - measured).cast("double")
    error = F.when(~F.isnan(error), error)
    everything = (
        _by_segment(df, segments or {"all": F.lit(True)})
        .select(
            "segment",
            error.alias("value"),
            F.when(measured != 0, error / measured).alias("relative"),
        )
        .withColumn("step", _stepped(F.col("value")))
    )
    values = everything.where(F.col("value").isNotNull())
    # Rows without a value have a null step of their own.
    histogram = everything.groupBy("segment", "step").agg(
        F.count("value").alias("n"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"),
        F.sum("value").alias("error_sum"),
        F.count("relative").alias("n_relative"),
        F.sum("relative").alias("relative_sum"),
        *[
            F.count(F.when(F.col("relative") > t, 1)).alias(f"above_{round(t * 100)}")
            for t in LARGE_ERRORS
        ],
    )

    def per_row(name: str) -> Column:
        return F.try_divide(F.sum(name), F.sum("n_relative"))

    summary = histogram.groupBy("segment").agg(
        F.sum("n").alias("n"),
        (F.sum("error_sum") / F.sum("n")).cast("long").alias("mean_error_s"),
        F.round(per_row("relative_sum") * 100, 1).alias("mape_pct"),
        *[
            F.round(per_row(f"above_{round(t * 100)}") * 100, 1).alias(f"over{round(t * 100)}_pct")
            for t in LARGE_ERRORS
        ],
        (F.sum("n") - F.sum("n_relative")).alias("n_zero_truth"),
        F.sum("n_missing").alias("n_missing"),
    ).where("n > 0")
    rounded = _percentiles(values, histogram.where("step is not null"), PERCENTILES).select(
        "segment",
        *[F.round(f"p{round(p * 100)}", 1).alias(f"p{round(p * 100)}") for p in PERCENTILES],
    )
    return summary.join(rounded, "segment")


def ab_segments() -> dict[str, Column]:
    """Control and test groups of the online comparison."""
    return {
        "isdowngrade=1": F.col("isdowngrade").try_cast("int") == 1,
        "isdowngrade=0": F.col("isdowngrade").try_cast("int") == 0,
        "test_id=blank": F.col("test_id") == "blank",
        "test_id=new": F.col("test_id") == "new",
    }


def short_distance_segments(limit_m: float) -> dict[str, Column]:
    """All rows, and those whose courier was within the limit of the shop."""
    return {"all": F.lit(True), "short": F.col("real_time_line_distance") <= limit_m}
