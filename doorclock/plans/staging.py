"""Steps several outputs share are written once to the cluster's shared folder.

The folder is the session's `spark.checkpoint.dir`. What that setting names is taken to be shared,
whatever its scheme: a `file:` path may be a mounted volume. A session without the setting can stage
only if it runs on one machine; its warehouse folder serves then. Staged tables are removed when the
driver's process ends.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_folder(spark: SparkSession) -> str:
    """The shared folder; an error where executors and driver share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a step and read it back, so later steps neither repeat it nor depend on executors."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    where = _path(spark, path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def restored(model, spark: SparkSession, name: str):
    """A fitted model, written and read back without the summary of its training.

    The summary holds the session, which cannot be sent to tasks once it has observed a job.
    """
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    model.write().save(path)
    where = _path(spark, path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return type(model).load(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        where = _path(spark, path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are staged by now and that nothing refers to.

    Its cleaner learns of them from the collector, and the objects that hold them go in two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
