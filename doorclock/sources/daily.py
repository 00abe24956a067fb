"""Tables kept by day: a run replaces its own days as a whole, and readers see committed runs only.

Rows lie in `data/run=<run>/<day column>=<day>`. When they are all written, the run's days are named in
one small file of `commits`, which appears by a rename. A day belongs to the last committed run that
names it, so a run that fails, or is still writing, changes nothing for readers; other days stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorclock.settings import DateRange


def _files(spark: SparkSession, path: str):
    """The path's file system, and a function from text to its paths."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, to_path = _files(spark, folder)
    where = to_path(folder)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _committed(spark: SparkSession, path: str) -> dict[str, tuple[str, bool]]:
    """(run, whether it has rows) of each day."""
    runs = [name for name in _names(spark, f"{path}/commits") if not name.startswith((".", "_"))]
    if not runs:
        return {}
    lines = F.split("value", "\t")
    named = spark.read.text([f"{path}/commits/{run}" for run in runs]).select(
        F.get(lines, 0).alias("run"), F.get(lines, 1).alias("day"), (F.get(lines, 2) == "rows").alias("filled")
    )
    last = named.groupBy("day").agg(F.max(F.struct("run", "filled")).alias("last"))
    return {r.day: (r.last.run, r.last.filled) for r in last.collect()}  # a row per day


def _commit(spark: SparkSession, path: str, run: str, days: dict[str, bool]) -> None:
    fs, to_path = _files(spark, path)
    fs.mkdirs(to_path(f"{path}/commits"))
    waiting, final = to_path(f"{path}/commits/_{run}"), to_path(f"{path}/commits/{run}")
    out = fs.create(waiting)
    try:
        lines = [f"{run}\t{day}\t{'rows' if filled else 'none'}\n" for day, filled in sorted(days.items())]
        out.write(bytearray("".join(lines).encode()))
    finally:
        out.close()
    if not fs.rename(waiting, final):
        raise OSError(f"the run's days could not be committed: {final}")


def replace_days(df: DataFrame, path: str, days: Iterable[str], by: str = "day") -> DataFrame:
    """Replace the given days by the rows of `df`, also by none; an error if `df` has rows of other days.

    Returns the whole table as it is then. Files of a day are split or joined by size as they are written.
    """
    spark, days = df.sparkSession, set(days)
    runs = [name.lstrip("_") for name in _names(spark, f"{path}/commits")]
    number = 1 + max((int(name.split("-")[0]) for name in runs), default=0)
    run = f"{number:09d}-{uuid.uuid4().hex}"
    folder = f"{path}/data/run={run}"
    df.hint("rebalance", by).write.partitionBy(by).parquet(folder)
    found = {name.split("=", 1)[1] for name in _names(spark, folder) if name.startswith(f"{by}=")}
    if found - days:
        fs, to_path = _files(spark, folder)
        fs.delete(to_path(folder), True)
        raise ValueError(f"rows of days that the run does not replace: {sorted(found - days)[:5]}")
    _commit(spark, path, run, {day: day in found for day in days})
    nothing = df.limit(0).select(*[c for c in df.columns if c != by], by)
    return read_days(spark, path, by=by, nothing=nothing)


def read_days(
    spark: SparkSession, path: str, dates: DateRange | None = None, by: str = "day", nothing: DataFrame | None = None
) -> DataFrame:
    """Committed rows, of a range of days or of all; only the folders of these days are listed and read.

    A table without any rows has no columns to show; `nothing` is then returned, or else it is an error.
    """
    filled = {day: run for day, (run, rows) in _committed(spark, path).items() if rows}
    if not filled:
        if nothing is None:
            raise FileNotFoundError(f"no committed rows: {path}")
        return nothing
    wanted = {day: run for day, run in filled.items() if dates is None or dates.first <= day <= dates.last}
    folders = [f"{path}/data/run={run}/{by}={day}" for day, run in sorted((wanted or filled).items())]
    table = spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("run")
    table = table.withColumn(by, F.col(by).cast("string"))
    return table if wanted else table.limit(0)


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether no run has committed rows that are still current."""
    return not any(rows for _, rows in _committed(spark, path).values())


def remove_replaced(spark: SparkSession, path: str, by: str = "day") -> int:
    """Delete rows of committed runs that later runs replaced; the number of folders."""
    fs, to_path = _files(spark, path)
    current = {(run, day) for day, (run, _) in _committed(spark, path).items()}
    removed = 0
    for run in _names(spark, f"{path}/commits"):
        for name in _names(spark, f"{path}/data/run={run}"):
            if name.startswith(f"{by}=") and (run, name.split("=", 1)[1]) not in current:
                removed += bool(fs.delete(to_path(f"{path}/data/run={run}/{name}"), True))
    return removed
