"""Two-class evaluation over (label, score) rows; label is 1 or -1, score a probability."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorclock.operators.prefix import falling_totals

# The sweep adds up its step, as the thresholds have always been formed.
SWEEP = list(accumulate([0.05] * 19))


def class_label(text: Column) -> Column:
    """1 for class 1, -1 for any other whole number, null for anything else."""
    value = text.try_cast("int")
    return F.when(value == 1, 1).when(value.isNotNull(), -1)


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("num"),
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("label") == -1, 1)).alias("neg"),
    )


def _score_counts(scored: DataFrame) -> DataFrame:
    """Positive and negative rows per distinct score."""
    return scored.groupBy("score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("label") == -1, 1)).alias("neg"),
    )


def roc_points(scored: DataFrame) -> DataFrame:
    """False and true positive rate for each distinct score taken as threshold, and the origin."""
    counts = falling_totals(_score_counts(scored), "score", {"pos": "tp", "neg": "fp"})
    # The lowest score accepts everything; per-score counts are what is read again, not the rows.
    points = counts.select(
        F.col("score").alias("threshold"),
        "fp",
        "tp",
        F.try_divide(F.col("fp"), counts.agg(F.max("fp")).scalar()).alias("fpr"),
        F.try_divide(F.col("tp"), counts.agg(F.max("tp")).scalar()).alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("long").alias("fp"),
        F.lit(0).cast("long").alias("tp"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(points)


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve, one row: equal scores count half."""
    counts = falling_totals(_score_counts(scored), "score", {"pos": "pos_through"})
    above = F.col("pos_through") - F.col("pos")
    pairs = (F.col("neg") * (above + F.col("pos") / 2)).cast("double")
    return counts.agg(
        F.try_divide(F.sum(pairs), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def _scores(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision and recall; a ratio without cases is 0."""

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
    }


def threshold_sweep(scored: DataFrame, thresholds: list[float] = SWEEP) -> DataFrame:
    """Predicted classes and their quality at each threshold.

    Each row is counted once, under the number of thresholds its score reaches; what a threshold
    accepts is then the sum of a few counts. Rows are never repeated per threshold.
    """
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    levels = scored.groupBy(reached.alias("level")).agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("label") == -1, 1)).alias("neg"),
    )

    def accepted(side: str, i: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("level") >= i, F.col(side))), F.lit(0))

    def rejected(side: str, i: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("level") < i, F.col(side))), F.lit(0))

    per_threshold = F.array(
        *[
            F.struct(
                F.lit(t).alias("prob"),
                accepted("pos", i).alias("tp"),
                accepted("neg", i).alias("fp"),
                rejected("neg", i).alias("tn"),
                rejected("pos", i).alias("fn"),
            )
            for i, t in enumerate(thresholds, start=1)
        ]
    )
    table = levels.agg(per_threshold.alias("rows")).select(F.inline("rows"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        table.withColumns(_scores(tp, fp, tn, fn))
        .withColumn("auc", auc(scored).scalar())
        .select(
            F.round("prob", 2).alias("prob"),
            (tn + fn).alias("neg_num"),
            (tp + fp).alias("pos_num"),
            F.try_divide(tp + fp, tp + fp + tn + fn).alias("pk_ratio"),
            "accuracy",
            "precision",
            "recall",
            "auc",
        )
    )


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class counts, accuracy, precision and recall at one threshold, and the AUC."""
    yes = F.col("score") >= threshold
    real = F.col("label") == 1
    cells = {
        "tp": yes & real,
        "fp": yes & ~real,
        "tn": ~yes & ~real,
        "fn": ~yes & real,
    }
    table = scored.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in cells.items()])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        table.withColumns(_scores(tp, fp, tn, fn))
        .withColumn("auc", auc(scored).scalar())
        .select(
            (tp + fp + tn + fn).alias("num"),
            (tp + fn).alias("pos"),
            (tn + fp).alias("neg"),
            "accuracy",
            "precision",
            "recall",
            "auc",
        )
    )
