"""Outputs: tables, tab-separated exports, published tables and model artefacts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorclock.plans.staging import staged
from doorclock.schemas import conformed
from doorclock.sources import daily


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a step as parquet, replacing what was there, and read it back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def export_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated directory, nulls written as NULL, no header."""
    df.write.mode("overwrite").option("sep", "\t").option("nullValue", "NULL").option(
        "quote", ""
    ).csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Comma-separated directory with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def _checked(df: DataFrame, layout: dict, keys: list[str]) -> DataFrame:
    """The table in its published layout, computed once; an error if its key or its id is not unique."""
    table = staged(conformed(df, layout), "published")
    for unique in (keys, ["id"]):
        if set(unique) <= set(df.columns) and not duplicate_keys(table, unique).isEmpty():
            raise ValueError(f"published key is not unique: {unique}")
    return table


def publish(df: DataFrame, layout: dict, keys: list[str], path: str) -> DataFrame:
    """Write a history table in its published layout; refuse it if its key is not unique."""
    return replace_table(_checked(df, layout, keys), path)


def publish_merged(df: DataFrame, layout: dict, keys: list[str], path: str) -> DataFrame:
    """Merge a run into the published table by its unique key, as one committed version.

    A new key is inserted. A known one keeps its id and its time of creation; it takes the run's values and
    time of update if a value differs, and stays as it is if none does. Keys that the run lacks stay.
    """
    spark = df.sparkSession
    run = _checked(df, layout, keys).select(F.struct(*layout).alias("new"))
    if daily.is_empty(spark, path):
        merged = run.select("new.*")
    else:
        old = daily.read_days(spark, path, by="version").select(F.struct(*layout).alias("old"))
        same_key = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        both = old.join(run, same_key, "full")
        values = [c for c in layout if c not in (*keys, "id", "create_time", "update_time")]
        known, given = F.col("old").isNotNull(), F.col("new").isNotNull()
        changed = ~F.struct(*[f"old.{c}" for c in values]).eqNullSafe(F.struct(*[f"new.{c}" for c in values]))
        taken = given & (~known | changed)

        def column(name: str):
            own = known if name in ("id", "create_time") else ~taken
            return F.when(own, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name)

        merged = both.select(*map(column, layout))
    version = daily.replace_days(merged.withColumn("version", F.lit("current")), path, ["current"], by="version")
    return version.select(*layout)  # without rows if no run had any


def publish_jdbc(df: DataFrame, layout: dict, keys: list[str], url: str, table: str, **options: str) -> None:
    """The same into a database table. The run's rows replace those of an earlier run."""
    rows = _checked(df, layout, keys)
    rows.write.mode("overwrite").option("truncate", "true").format("jdbc").options(url=url, dbtable=table, **options).save()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_importance(importance: DataFrame, path: str) -> None:
    """Feature importance or coefficients, largest first. One row per encoded feature."""
    export_csv(importance.orderBy(F.desc("value"), "feature").coalesce(1), path)


def save_coefficients(coefficients: DataFrame, path: str) -> None:
    """One line per encoded feature, name and value apart by a tab, in the model's order, no header."""
    lines = coefficients.coalesce(1).select(F.concat_ws("\t", "feature", F.col("value").cast("string")).alias("value"))
    lines.write.mode("overwrite").text(path)


# File format: titles and widths. Fixed values.
THRESHOLD_TITLE = "%6s%10s%10s%12s%12s%11s%8s%10s" % (
    "prob", "neg_num", "pos_num", "pk_ratio", "accuracy", "precison", "recall", "auc"
)
THRESHOLD_LINE = "%6.2f%10d%10d%10.2f%%%10.2f%%%10.2f%%%10.2f%%%10.4f"


def threshold_lines(sweep: DataFrame) -> DataFrame:
    """The threshold sweep as report lines, the title first; as many rows as thresholds."""
    percent = [F.col(c) * 100 for c in ("pk_ratio", "accuracy", "precision", "recall")]
    line = F.format_string(THRESHOLD_LINE, "prob", "neg_num", "pos_num", *percent, "auc")
    title = sweep.sparkSession.range(1).select(F.lit(-1.0).alias("_at"), F.lit(THRESHOLD_TITLE).alias("value"))
    return title.unionByName(sweep.select(F.col("prob").alias("_at"), line.alias("value"))).orderBy("_at").select("value")


def save_threshold_report(sweep: DataFrame, path: str) -> None:
    threshold_lines(sweep).coalesce(1).write.mode("overwrite").text(path)


def save_prepared(rows: DataFrame, encode: PipelineModel, folder: str, name: str) -> None:
    """Keep a prepared sample and its fitted encoder under a name, for later runs."""
    rows.write.mode("overwrite").parquet(f"{folder}/{name}/rows")
    encode.write().overwrite().save(f"{folder}/{name}/encoder")


def load_prepared(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, PipelineModel]:
    return spark.read.parquet(f"{folder}/{name}/rows"), PipelineModel.load(f"{folder}/{name}/encoder")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
