"""Session settings the jobs are tuned for; a cluster's own settings always win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Fact-to-dimension joins on a courier, shop or landmark that owns a large share of the rows
    # are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    # Query-context capture costs several JVM calls for every Column function.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def apply_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The same settings for a cluster's session; set others on the builder afterwards to override."""
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def local_session(app: str = "doorclock", cpus: int | None = None, **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = apply_defaults(SparkSession.builder.master(f"local[{cpus}]").appName(app))
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
