"""Boosted trees for absolute error, and fitted models as Column expressions.

Each round fits a tree to the signs of the residuals, which says where to go up or down, and then gives each
leaf the exact median of its residuals, which is how far: the step that lowers the mean absolute error most.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorclock.operators.errors import exact_percentiles, percentiles_by
from doorclock.plans.staging import dropped, staged


@dataclass(frozen=True)
class Node:
    """A split by `feature` (at most `threshold`, or in `categories`, goes left), or a leaf without one."""

    value: float
    rows: int = 0
    feature: int = -1
    threshold: float | None = None
    categories: tuple[float, ...] = ()
    sides: tuple[Node, ...] = ()

    def leaves(self) -> Iterator[Node]:
        """From left to right, as a fitted tree numbers them."""
        if not self.sides:
            yield self
        for side in self.sides:
            yield from side.leaves()

    def with_leaves(self, leaves: Iterator[Node]) -> Node:
        if not self.sides:
            return next(leaves)
        return replace(self, sides=tuple(side.with_leaves(leaves) for side in self.sides))

    def table(self, step: float = 1.0) -> list[dict]:
        """The nodes as rows that name each other by place, from 1, the root first; a leaf has no feature."""
        rows: list[dict] = []

        def add(node: Node) -> int:
            row = {"feature": node.feature, "value": step * node.value}
            rows.append(row)
            place = len(rows)
            if node.sides:
                row |= {"threshold": node.threshold, "categories": list(node.categories)}
                row["left"], row["right"] = [add(side) for side in node.sides]
            return place

        add(self)
        return rows

    def depth(self) -> int:
        return 1 + max(side.depth() for side in self.sides) if self.sides else 0


NODE = "feature:int,value:double,threshold:double,categories:array<double>,left:int,right:int"


def leaf_of(tree: Column, features: Column, depth: int) -> Column:
    """The row of a tree's table in which an array of features ends. The row itself is carried on, so it is looked up once a level."""

    def below(node: Column, _: Column) -> Column:
        value = F.get(features, node["feature"])
        left = F.when(node["threshold"].isNotNull(), value <= node["threshold"]).otherwise(F.array_contains(node["categories"], value))
        return F.when(node["feature"] < 0, node).otherwise(F.element_at(tree, F.when(left, node["left"]).otherwise(node["right"])))

    root = F.element_at(tree, 1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, below) if depth else root


def read_tree(model: DecisionTreeRegressionModel) -> Node:
    """The nodes of a fitted tree; model-sized."""

    def read(node) -> Node:
        if node.subtreeDepth() == 0:
            return Node(float(node.prediction()))
        split, sides = node.split(), (read(node.leftChild()), read(node.rightChild()))
        if "CategoricalSplit" in split.getClass().getName():
            return Node(0.0, feature=split.featureIndex(), categories=tuple(split.leftCategories()), sides=sides)
        return Node(0.0, feature=split.featureIndex(), threshold=float(split.threshold()), sides=sides)

    return read(model._java_obj.rootNode())


NODES = "tree int, node int, parent int, side int, value double, rows long, feature int, threshold double, categories array<double>"


@dataclass(frozen=True)
class BoostedTrees:
    """`start` plus the value of the leaf that a row falls into, for each tree: the first in full, others by `step`."""

    start: float
    step: float
    trees: list[Node] = field(default_factory=list)

    def steps(self) -> list[float]:
        return [1.0, *[self.step] * (len(self.trees) - 1)][: len(self.trees)]

    def expression(self, features: Column) -> Column:
        """The prediction. The trees are one constant of the plan, walked by the same few expressions whatever their number."""
        trees = list(zip(self.trees, self.steps(), strict=True))
        start = F.lit(self.start)
        if not trees:
            return start
        known = F.from_json(F.lit(json.dumps([tree.table(step) for tree, step in trees])), f"array<array<struct<{NODE}>>>")
        depth = max(tree.depth() for tree, _ in trees)
        return F.aggregate(known, start, lambda total, tree: total + leaf_of(tree, features, depth)["value"])

    def predict(self, rows: DataFrame, features: str = "features", name: str = "prediction") -> DataFrame:
        return predicted_by(rows, self.expression, features, name)

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per node; the first one holds start and step."""
        rows: list[tuple] = [(-1, 0, -1, 0, self.start, 0, -1, self.step, [])]

        def add(tree: int, node: Node, parent: int, side: int) -> None:
            number = len(rows)
            rows.append((tree, number, parent, side, node.value, node.rows, node.feature, node.threshold, list(node.categories)))
            for k, child in enumerate(node.sides):
                add(tree, child, number, k)

        for k, tree in enumerate(self.trees):
            add(k, tree, -1, 0)
        spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        first, *rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.node)
        children: dict[int, list] = {}
        for r in rows:
            children.setdefault(r.parent, []).append(r)

        def made(r) -> Node:
            sides = tuple(made(c) for c in sorted(children.get(r.node, []), key=lambda c: c.side))
            return Node(r.value, r.rows, r.feature, r.threshold, tuple(r.categories), sides)

        return BoostedTrees(first.value, first.threshold, [made(r) for r in rows if r.parent == -1])


def predicted_by(
    rows: DataFrame, expression: Callable[[Column], Column], features: str = "features", name: str = "prediction"
) -> DataFrame:
    """Rows with an expression over their feature vector, which becomes an array once per row."""
    once = rows.withColumn("_features", F.explode(F.array(vector_to_array(features))))
    return once.withColumn(name, expression(F.col("_features"))).drop("_features")


def ensemble(model) -> BoostedTrees:
    """A fitted `GBTRegressionModel` as the same kind of thing, its weights put into the leaves."""
    trees = []
    for fitted, weight in zip(model.trees, model.treeWeights, strict=True):
        tree = read_tree(fitted)
        trees.append(tree.with_leaves(iter([replace(leaf, value=weight * leaf.value) for leaf in tree.leaves()])))
    return BoostedTrees(0.0, 1.0, trees)


def logistic_expression(model, features: Column) -> Column:
    """The probability of class 1 of a fitted `LogisticRegressionModel`."""
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients.toArray()])
    products = F.zip_with(features, weights, lambda x, w: x * w)
    margin = F.aggregate(products, F.lit(float(model.intercept)), lambda total, x: total + x)
    return 1 / (1 + F.exp(-margin))


def train_absolute(
    rows: DataFrame,
    target: str,
    features: str = "features",
    trees: int = 80,
    step: float = 0.1,
    depth: int = 5,
    max_bins: int = 32,
    seed: int = 40,
) -> BoostedTrees:
    """Fit to encoded rows. What comes to the driver in a round is a tree and a row per leaf.

    The first tree is fitted to the residuals themselves and counts in full, the others to their signs.
    """
    known = rows.select(F.col(features).alias("features"), F.col(target).cast("double").alias("target")).where("target is not null")
    start = exact_percentiles(known, F.col("target"), (0.5,)).first()
    model = BoostedTrees(float(start.p50) if start else 0.0, step)
    if start is None:
        return model
    table = stored = staged(known.withColumn("so_far", F.lit(model.start)), "boosting-rows")
    residual = F.col("target") - F.col("so_far")
    for number in range(trees):
        trainer = DecisionTreeRegressor(
            featuresCol="features", labelCol="sign", maxDepth=depth, maxBins=max_bins, seed=seed + number, leafCol="leaf"
        )
        wanted = F.signum(residual) if number else residual
        fitted = trainer.fit(table.select("features", wanted.alias("sign")))
        # A round is written with its leaves: a row walks each tree once, however many rounds there are.
        leaf = F.col("leaf").cast("int").alias("leaf")
        older, stored = stored, staged(fitted.transform(table).select(*known.columns, "so_far", leaf), "boosting-rows")
        dropped(older)
        medians = percentiles_by(stored, F.col("leaf").cast("string"), residual, (0.5,), with_counts=True)
        found = {int(r.segment): (r.p50, r.n) for r in medians.collect()}  # a row per leaf
        tree = read_tree(fitted)
        leaves = [Node(*found.get(k, (0.0, 0))) for k, _ in enumerate(tree.leaves())]
        model.trees.append(tree.with_leaves(iter(leaves)))
        steps = F.array(*[F.lit(model.steps()[-1] * node.value) for node in leaves])
        table = stored.select(*known.columns, (F.col("so_far") + F.get(steps, F.col("leaf"))).alias("so_far"))
    dropped(stored)
    return model
