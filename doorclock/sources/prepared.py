"""Prepared samples that are used again only while nothing they came from has changed.

A sample's name holds a digest of its input files (path, length, time of change), of the parameters, and of
the code that prepares it. A changed file, parameter or line of code gives another name, so a stale sample
is never read; one that was not written to its end has no marker and is prepared anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path
from types import ModuleType
from typing import Any, NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorclock.sources import sinks

DONE = "_PREPARED"


class Prepared(NamedTuple):
    rows: DataFrame
    encode: PipelineModel
    name: str
    reused: bool


def files_digest(spark: SparkSession, *paths: str) -> str:
    """What files a path holds, without reading them; listed and summed by Spark, whatever their number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    found = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.sum(one).alias("sum")).first()
    return f"{found.n}:{found.bytes}:{found.sum}"


def code_digest(*modules: ModuleType) -> str:
    return hashlib.sha256(b"".join(Path(m.__file__).read_bytes() for m in modules)).hexdigest()


def fingerprint(inputs: str, parameters: dict[str, Any], code: str) -> str:
    text = json.dumps({"inputs": inputs, "parameters": parameters, "code": code}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def prepared_sample(
    spark: SparkSession,
    folder: str,
    label: str,
    paths: list[str],
    parameters: dict[str, Any],
    modules: list[ModuleType],
    prepare: Callable[[], tuple[DataFrame, PipelineModel]],
) -> Prepared:
    """The sample that is kept under its fingerprint, or the one that `prepare` gives, kept for the next run."""
    name = f"{label}-{fingerprint(files_digest(spark, *paths), parameters, code_digest(*modules))}"
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    marker = to_path(f"{folder}/{name}/{DONE}")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    reused = bool(fs.exists(marker))
    if not reused:
        sinks.save_prepared(*prepare(), folder, name)
        fs.create(marker).close()
    return Prepared(*sinks.load_prepared(spark, folder, name), name, reused)
