"""Categories to indicator columns, numbers as they are, in one sparse vector."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import Vector, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _indexer(categories: list[str], indexed: list[str]) -> StringIndexer:
    return StringIndexer(
        inputCols=categories,
        outputCols=indexed,
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )


def tree_encoder(categories: list[str], numbers: list[str], output: str = "features") -> Pipeline:
    """Categories as one indexed column each, which trees split by sets of values.

    The vector names its categories, so that trees know them; unseen ones share an index of their own.
    """
    indexed = [f"{c}_index" for c in categories]
    return Pipeline(
        stages=[_indexer(categories, indexed), VectorAssembler(inputCols=indexed + numbers, outputCol=output)]
    )


def largest_category(model: PipelineModel) -> int:
    """The number of values of the category that has most, the one for unseen values included."""
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    return max((len(labels) + 1 for labels in indexer.labelsArray), default=1)


def encoder(rows: DataFrame, categories: list[str], numbers: list[str], output: str = "features") -> PipelineModel:
    """Fitted to the rows. A category not seen in fitting gives zeros in all its columns.

    A column without any value in the rows has no indicators, and a table without rows has numbers only.
    """
    indexer = _indexer(categories, [f"{c}_index" for c in categories]).fit(rows)
    valued = [c for c, labels in zip(categories, indexer.labelsArray) if labels]
    hot = [f"{c}_hot" for c in valued]
    assemble = VectorAssembler(inputCols=hot + numbers, outputCol=output)
    if not valued:
        return PipelineModel([indexer, assemble])
    one_hot = OneHotEncoder(inputCols=[f"{c}_index" for c in valued], outputCols=hot, dropLast=True)
    return PipelineModel([indexer, one_hot.fit(indexer.transform(rows)), assemble])


def feature_names(model: PipelineModel, numbers: list[str]) -> list[str]:
    """Name of each vector element: `category=value` (of trees: `category`), then the numbers."""
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    assembled = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    if set(indexer.getOutputCols()) & set(assembled):
        return [*indexer.getInputCols(), *numbers]
    hot = [
        f"{column}={label}"
        for column, labels in zip(indexer.getInputCols(), indexer.labelsArray)
        for label in labels
    ]
    return hot + numbers


def per_feature(df: DataFrame, values: dict[str, Vector], names: list[str]) -> DataFrame:
    """One row per encoded feature, with one column per vector (model-sized, not data-sized)."""
    columns = [[float(x) for x in v.toArray()] for v in values.values()]
    rows = [(name, *parts) for name, *parts in zip(names, *columns)]
    schema = "feature string, " + ", ".join(f"`{v}` double" for v in values)
    return df.sparkSession.createDataFrame(rows, schema)


def encoded_totals(model: PipelineModel, df: DataFrame, numbers: list[str]) -> DataFrame:
    """Rows with a value other than zero, and the sum, per encoded feature; of no rows, 0 and null."""
    summary = (
        model.transform(df)
        .groupBy(F.lit(1))  # no row at all where there is nothing to summarise
        .agg(Summarizer.metrics("numNonZeros", "sum").summary(F.col("features")).alias("s"))
        .select("s.numNonZeros", "s.sum")
        .first()
    )
    names = feature_names(model, numbers)
    nothing = Vectors.dense([0.0] * len(names))
    values = {"n_nonzero": summary["numNonZeros"], "total": summary["sum"]} if summary else {"n_nonzero": nothing, "total": nothing}
    totals = per_feature(df, values, names).withColumn("n_nonzero", F.col("n_nonzero").cast("long"))
    return totals if summary else totals.withColumn("total", F.lit(None).cast("double"))


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("value"), "feature").limit(n)
