"""Delimited sample files and evaluation CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doorclock.functions.text import mask_null_words, split_fields, stripped
from doorclock.plans.staging import staged


def parse_lines(
    lines: DataFrame, columns: list[str], column: str = "value", mask_nulls: bool = True
) -> DataFrame:
    """Text lines as named string columns.

    Null words become -1 in the samples of both phases (`mask_nulls`). The courier-rating samples keep
    them: in a number they fail the line later, in a category they are a category.

    A short line gives nulls, so the feature step drops it. Blank lines are skipped: rows have no
    order, so a blank one cannot end the input; `first_lines` sees to that for files.
    """
    line = stripped(F.col(column))
    fields = split_fields(mask_null_words(line) if mask_nulls else line)
    return (
        lines.where(line != "")
        # A one-element generator: the line is split once, however many later filters read a field.
        .select(F.explode(F.array(fields)).alias("_fields"))
        .select(*[F.get("_fields", i).alias(name) for i, name in enumerate(columns)])
    )


TASK_BYTES = 128 * 2**20
TASKS_PER_CORE = 4


def _several_splits_a_task(lines: DataFrame) -> DataFrame:
    """The same splits, read one after the other in fewer tasks, so that a task is worth its start however short splits are."""
    read = lines._jdf.queryExecution()
    size = int(str(read.optimizedPlan().stats().sizeInBytes()))  # by the files
    tasks = max(TASKS_PER_CORE * lines.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return lines.coalesce(tasks)  # never more tasks than splits


def first_lines(spark: SparkSession, path: str, limit: int = -1, until_blank: bool = True) -> DataFrame:
    """(file, line, value): a file's lines up to its first blank one, numbered from 1; of all, the first `limit`.

    Files follow each other by path, and with `until_blank` only lines that are kept count towards the
    limit. A file may be read in many splits. Each split counts its lines and finds its first blank one; sums over
    the splits before it, by file and place in the file, then tell how many of its lines are taken. The
    lines are written once with their split, so both steps see the same splits, whatever executors are there. Short
    splits share a task, and stay splits of their own.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),  # rises along the lines of a split
    )
    lines = staged(_several_splits_a_task(lines), "sample-lines")
    blank = F.lit(until_blank) & (stripped(F.col("value")) == "")
    splits = lines.groupBy("file", "split").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"), F.min(F.when(blank, F.col("at"))).alias("blank")
    )
    # One row per split from here on.
    before_in_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    open_lines = F.when(F.max("blank").over(before_in_file).isNull(), F.coalesce(F.col("blank") - F.col("first"), F.col("lines")))
    splits = splits.select(
        "file", "split", "first",
        F.coalesce(F.sum("lines").over(before_in_file), F.lit(0)).alias("earlier"),
        F.coalesce(open_lines, F.lit(0)).alias("taken"),
    )
    if limit != -1:
        rest = F.lit(limit) - F.coalesce(F.sum("taken").over(before), F.lit(0))
        splits = splits.withColumn("taken", F.greatest(F.least("taken", rest), F.lit(0)))
    within = F.col("at") - F.col("first")
    return lines.join(splits.where("taken > 0"), ["file", "split"]).where(within < F.col("taken")).select(
        "file", (F.col("earlier") + within + 1).alias("line"), "value"
    )


def read_samples(
    spark: SparkSession,
    path: str,
    columns: list[str],
    limit: int = -1,
    mask_nulls: bool = True,
    until_blank: bool = True,
) -> DataFrame:
    """A sample file or directory up to each file's first blank line; of that, the first `limit` lines or all (-1)."""
    whole = limit == -1 and not until_blank
    lines = spark.read.text(path) if whole else first_lines(spark, path, limit, until_blank)
    return parse_lines(lines, columns, mask_nulls=mask_nulls)


def read_evaluation(spark: SparkSession, path: str, value: str, truth: str) -> DataFrame:
    """Evaluation CSV with a header: test group columns, a predicted and a measured time.

    Columns are matched by name, whatever their order and whatever else the file holds.
    """
    table = spark.read.csv(path, header=True)
    kinds = {"isdowngrade": "int", "test_id": "string", value: "double", truth: "double"}
    return table.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()])
