"""Training, scoring and evaluation of the delivery-time and courier-rating models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorclock.functions.scaling import compress, expand
from doorclock.operators.boosting import BoostedTrees, train_absolute
from doorclock.operators.encoding import encoder, feature_names, largest_category, per_feature, tree_encoder
from doorclock.operators.errors import error_report
from doorclock.operators.sampling import split_name
from doorclock.plans.staging import restored, staged

POSITIVE_WEIGHT = 0.84
NEGATIVE_WEIGHT = 0.16


@dataclass(frozen=True)
class Trained:
    """A fitted encoder-and-model pipeline and the names of its encoded features."""

    pipeline: PipelineModel
    names: list[str]

    @property
    def model(self):
        return self.pipeline.stages[-1]


def fit_encoder(rows: DataFrame, categories: list[str], numbers: list[str]) -> PipelineModel:
    return encoder(rows, categories, numbers)


def fit_tree_encoder(rows: DataFrame, categories: list[str], numbers: list[str]) -> PipelineModel:
    return tree_encoder(categories, numbers).fit(rows)


def shared_out(rows: DataFrame) -> DataFrame:
    """Rows in equal shares, one for each core.

    Learning reads its rows hundreds of times in passes too short for more tasks than cores, and a pass lasts as
    long as its largest share. Files are as large as the step before left them.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def train_duration(
    rows: DataFrame,
    label: str,
    encode: PipelineModel,
    numbers: list[str],
    trees: int = 80,
    step: float = 0.1,
    seed: int = 40,
) -> Trained:
    """Boosted trees on log(1 + seconds) with absolute loss. `rows` may be encoded already."""
    trainer = GBTRegressor(
        featuresCol="features",
        labelCol="_target",
        lossType="absolute",
        maxIter=trees,
        stepSize=step,
        seed=seed,
        maxBins=max(32, largest_category(encode)),
        checkpointInterval=10,  # cuts the lineage of the boosting rounds where a checkpoint folder is set
    )
    encoded = rows if "features" in rows.columns else encode.transform(rows)
    model = trainer.fit(shared_out(encoded.select("features", compress(F.col(label)).alias("_target"))))
    return Trained(PipelineModel([*encode.stages, model]), feature_names(encode, numbers))


def score_duration(pipeline: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add `predicted` seconds."""
    scored = pipeline.transform(rows).withColumn("predicted", expand(F.col("prediction")))
    return scored.select(*rows.columns, "predicted")


def fit_report(scored: DataFrame, key: str, label: str) -> DataFrame:
    """Errors on training and test rows side by side, to see over-fitting."""
    side = split_name(F.col(key))
    return error_report(
        scored,
        F.col("predicted"),
        F.col(label),
        {"train": side == "train", "test": side == "test"},
    )


PICKUP_LABELS = ["label_a1", "label_a2"]


def train_pickup(
    rows: DataFrame, encode: PipelineModel, numbers: list[str], trees: int = 80
) -> dict[str, Trained]:
    """One model for riding to the shop and one for waiting there, on the same features.

    Both are trained at the same time: a round is a chain of short jobs that leaves cores idle. The
    rows are encoded once for both. Without rows there is nothing to learn from, and no model.
    """
    rows = staged(encode.transform(rows).select("features", *PICKUP_LABELS), "encoded")
    if rows.isEmpty():
        return {}
    with ThreadPoolExecutor(len(PICKUP_LABELS)) as pool:
        models = pool.map(
            lambda label: train_duration(rows, label, encode, numbers, trees), PICKUP_LABELS
        )
        return dict(zip(PICKUP_LABELS, models))


def pickup_report(models: dict[str, Trained], rows: DataFrame) -> DataFrame:
    """Errors of both pick-up models on training and test rows; no row without models."""
    if not models:
        unscored = rows.select("delivery_id", PICKUP_LABELS[0], F.lit(None).cast("double").alias("predicted")).limit(0)
        return fit_report(unscored, "delivery_id", PICKUP_LABELS[0]).select(F.lit("").alias("model"), "*")

    def report(label: str, trained: Trained) -> DataFrame:
        # A report reads its rows twice; the trees should not be walked twice.
        scored = score_duration(trained.pipeline, rows).select("delivery_id", label, "predicted")
        name = label.removeprefix("label_")
        return fit_report(staged(scored, f"scored-{name}"), "delivery_id", label).select(
            F.lit(name).alias("model"), "*"
        )

    return reduce(DataFrame.unionByName, [report(*item) for item in models.items()])


def train_rating(rows: DataFrame, encode: PipelineModel, numbers: list[str]) -> Trained:
    """Logistic regression with L2 penalty (C = 1) and fixed class weights; label is 1 or -1."""
    weighted = encode.transform(rows).select(
        "features",
        F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("_target"),
        F.when(F.col("label") == 1, POSITIVE_WEIGHT).otherwise(NEGATIVE_WEIGHT).alias("_weight"),
    )
    total = weighted.agg(F.sum("_weight")).first()[0]
    model = LogisticRegression(
        labelCol="_target",
        weightCol="_weight",
        standardization=False,
        regParam=1.0 / total,
        elasticNetParam=0.0,
        maxIter=10000,
        tol=1e-4,
    ).fit(weighted)
    model = restored(model, rows.sparkSession, "rating-model")
    return Trained(PipelineModel([*encode.stages, model]), feature_names(encode, numbers))


def score_rating(pipeline: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add `prob`, the probability of class 1."""
    scored = pipeline.transform(rows)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("prob"))


def importance(trained: Trained, rows: DataFrame) -> DataFrame:
    return per_feature(rows, {"value": trained.model.featureImportances}, trained.names)


def coefficients(trained: Trained, rows: DataFrame) -> DataFrame:
    return per_feature(rows, {"value": trained.model.coefficients}, trained.names)


def gradient(trained: Trained, rows: DataFrame, penalty: float = 1.0) -> DataFrame:
    """One row per coefficient: the slope of the penalised, weighted loss there, per unit of weight.

    At the optimum every slope is 0 up to the solver's tolerance; the bias is not penalised.
    """
    names = [*trained.names, "(bias)"]
    values = [*trained.model.coefficients.toArray().tolist(), trained.model.intercept]
    encoded = PipelineModel(trained.pipeline.stages[:-1]).transform(rows)
    scored = trained.model.transform(encoded.select("features", "label"))
    weight = F.when(F.col("label") == 1, POSITIVE_WEIGHT).otherwise(NEGATIVE_WEIGHT)
    residual = weight * (vector_to_array("probability")[1] - F.when(F.col("label") == 1, 1.0).otherwise(0.0))
    slope = scored.select(weight.alias("weight"), residual.alias("residual"), vector_to_array("features").alias("x"))
    terms = slope.select(
        "weight", F.posexplode(F.transform(F.array_append("x", F.lit(1.0)), lambda x: x * F.col("residual"))).alias("at", "term")
    )
    sums = terms.groupBy("at").agg(F.sum("term").alias("term"), F.sum("weight").alias("weight"))
    known = rows.sparkSession.createDataFrame(
        [(i, n, v, 0.0 if i == len(names) - 1 else penalty) for i, (n, v) in enumerate(zip(names, values))],
        "at int, feature string, value double, penalty double",
    )
    return known.join(sums, "at").select(
        "feature", "value", ((F.col("term") + F.col("penalty") * F.col("value")) / F.col("weight")).alias("slope")
    )


def read_quality(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """How many lines a sample has and how many of them gave no feature row."""
    good = parsed.agg(F.count(F.lit(1))).scalar()
    total = lines.where(F.trim("value") != "").agg(F.count(F.lit(1)).alias("n_lines"))
    return total.select("n_lines", (F.col("n_lines") - good).alias("n_failed"))


def train_duration_medians(
    rows: DataFrame, label: str, encode: PipelineModel, trees: int = 80, step: float = 0.1, seed: int = 40
) -> BoostedTrees:
    """As `train_duration`, but every leaf holds the median of its residuals. `rows` may be encoded already."""
    encoded = rows if "features" in rows.columns else encode.transform(rows)
    encoded = encoded.select("features", compress(F.col(label)).alias("_target"))
    return train_absolute(shared_out(encoded), "_target", trees=trees, step=step, max_bins=max(32, largest_category(encode)), seed=seed)


def score_duration_medians(encode: PipelineModel, model: BoostedTrees, rows: DataFrame) -> DataFrame:
    """Add `predicted` seconds."""
    scored = model.predict(encode.transform(rows)).withColumn("predicted", expand(F.col("prediction")))
    return scored.select(*rows.columns, "predicted")
