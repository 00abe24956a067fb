import math

import pytest
from pyspark.sql import functions as F

from doorclock.operators import audit, encoding, features
from doorclock.plans import training
from doorclock.sources import sinks


@pytest.fixture(scope="module")
def rows(spark):
    e = F.col("id")
    return spark.range(600).select(
        e.alias("key"),
        (e % 4).cast("string").alias("city"),
        (e % 50).cast("double").alias("x"),
        (60 + (e % 50) * 10 + (e % 4) * 40).cast("double").alias("label"),
    )


def test_two_pickup_models(spark, rows):
    data = rows.select(F.col("key").alias("delivery_id"), "city", "x", F.col("label").alias("label_a1"), (F.col("label") * 2).alias("label_a2"))
    encode = training.fit_encoder(data, ["city"], ["x"])
    models = training.train_pickup(data, encode, ["x"], trees=3)
    report = training.pickup_report(models, data).collect()
    assert {(r["model"], r["segment"]) for r in report} == {(m, s) for m in ("a1", "a2") for s in ("train", "test")}
    assert sum(r["n"] for r in report) == 1200


def test_pickup_models_of_no_rows(spark, rows):
    data = rows.select(F.col("key").alias("delivery_id"), "city", "x", F.col("label").alias("label_a1"), F.col("label").alias("label_a2"))
    empty = data.limit(0)
    encode = training.fit_tree_encoder(empty, ["city"], ["x"])
    report = training.pickup_report(training.train_pickup(empty, encode, ["x"], trees=3), empty)
    full = training.pickup_report(training.train_pickup(data, encode, ["x"], trees=1), data)
    assert report.collect() == [] and report.dtypes == full.dtypes


def test_encoded_totals_of_no_rows_and_of_a_category_without_values(spark, rows):
    totals = encoding.encoded_totals(training.fit_encoder(rows.limit(0), ["city"], ["x"]), rows.limit(0), ["x"])
    assert [tuple(r) for r in totals.collect()] == [("x", 0, None)]
    data = rows.withColumn("none", F.lit(None).cast("string"))
    totals = encoding.encoded_totals(training.fit_encoder(data, ["none", "city"], ["x"]), data, ["x"]).collect()
    assert [r.feature for r in totals] == ["city=0", "city=1", "city=2", "city=3", "x"]
    assert [r.n_nonzero for r in totals] == [150, 150, 150, 150, 588] and totals[-1].total == pytest.approx(14700)


def test_unseen_category_gives_zeros(spark, rows):
    model = training.fit_encoder(rows, ["city"], ["x"])
    names = encoding.feature_names(model, ["x"])
    assert names == ["city=0", "city=1", "city=2", "city=3", "x"]
    new = spark.createDataFrame([("3", 7.0), ("99", 8.0)], "city string, x double")
    got = [list(r["features"].toArray()) for r in model.transform(new).collect()]
    assert got == [[0, 0, 0, 1, 7], [0, 0, 0, 0, 8]]


def test_duration_model(spark, rows, tmp_path):
    encode = training.fit_encoder(rows, ["city"], ["x"])
    trained = training.train_duration(rows, "label", encode, ["x"], trees=10)
    scored = training.score_duration(trained.pipeline, rows)
    got = {r["key"]: r["predicted"] for r in scored.collect()}
    assert len(got) == 600 and all(math.isfinite(v) for v in got.values())
    labels = {r["key"]: r["label"] for r in rows.collect()}
    error = sum(abs(got[k] - labels[k]) for k in got) / len(got)
    middle = sorted(labels.values())[300]
    assert error < sum(abs(middle - v) for v in labels.values()) / len(labels)

    again = training.train_duration(rows, "label", encode, ["x"], trees=10)
    same = {r["key"]: r["predicted"] for r in training.score_duration(again.pipeline, rows).collect()}
    assert same == got

    sinks.save_model(trained.pipeline, str(tmp_path / "model"))
    loaded = training.score_duration(sinks.load_model(str(tmp_path / "model")), rows)
    assert {r["key"]: r["predicted"] for r in loaded.collect()} == got

    table = training.importance(trained, rows)
    sinks.save_importance(table, str(tmp_path / "importance"))
    saved = spark.read.csv(str(tmp_path / "importance"), header=True, inferSchema=True).collect()
    assert saved[0]["feature"] == "x" and len(saved) == 5
    assert encoding.top_features(table, 1).first()["feature"] == "x"

    report = {r["segment"]: r["n"] for r in training.fit_report(scored, "key", "label").collect()}
    assert sum(report.values()) == 600 and set(report) == {"train", "test"}


def test_rating_model(spark):
    e = F.col("id")
    data = spark.range(500).select(
        e.alias("key"), (e % 3).cast("string").alias("grade"), (e % 100 / 100).alias("x"),
        F.when(e % 100 > 80, 1).otherwise(-1).alias("label"),
    )
    encode = training.fit_encoder(data, ["grade"], ["x"])
    trained = training.train_rating(data, encode, ["x"])
    scored = training.score_rating(trained.pipeline, data)
    assert scored.where("prob < 0 or prob > 1").isEmpty() and scored.count() == 500
    weights = {r["feature"]: r["value"] for r in training.coefficients(trained, data).collect()}
    assert weights["x"] > 0


def test_rating_scores_in_a_session_that_has_observed_a_job(spark):
    seen, taken = audit.observed(spark.range(5), {"rows": F.count(F.lit(1))})
    assert seen.count() == 5 and taken.get["rows"] == 5
    rows = spark.range(200).select((F.col("id") % 4).cast("string").alias("grade"), (F.col("id") % 9).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 1).otherwise(-1).alias("label"))
    trained = training.train_rating(rows, training.fit_encoder(rows, ["grade"], ["x"]), ["x"])
    assert all(0 < r.prob < 1 for r in training.score_rating(trained.pipeline, rows).collect())


def test_current_values_follow_the_hour(spark):
    names = [*features._HANDOVER_REALS, *features._HANDOVER_WHOLES]
    values = {n: str(i) for i, n in enumerate(names)}
    values.update(cnt_peek1="1", cnt_peek2="2.9", cnt_peek3="3", cnt_peek0="0")
    rows = []
    for i, hour in enumerate((11, 9, 23, 13)):
        rows.append({"order_id": str(i), "cargo_type_id": "1", "city_id": "2", "finish_time": f"2024-01-01 {hour:02}:00:00", "delivery_time2": "60", **values})
    rows.append({**rows[0], "order_id": "zero label", "delivery_time2": "0"})
    rows.append({**rows[0], "order_id": "no number", "cargo_weight": "heavy"})
    got = features.handover_features(spark.createDataFrame(rows)).collect()
    assert {r["order_id"]: r["current_cnt_peek"] for r in got} == {"0": 1, "1": 2, "2": 3, "3": 0}


def test_city_speed_default(spark):
    df = spark.createDataFrame([(1,), (20,), (0,)], "city int")
    got = [r[0] for r in df.select(features.city_speed(F.col("city"))).collect()]
    assert got == [4.670976602114164, 4.5, 4.5]


def test_boosted_trees_of_leaf_medians(spark, tmp_path):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    from doorclock.operators import boosting

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 5.0, -2.0) + rng.standard_cauchy(600) * 0.3
    table = [(int(k), *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(table, "k int, a double, b double, c double, y double")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = boosting.train_absolute(rows, "y", trees=11, step=0.5, depth=3)

    # By hand, with the fitted splits.
    def leaf(node, v):
        while node.sides:
            node = node.sides[0 if v[node.feature] <= node.threshold else 1]
        return node

    so_far = np.full(600, np.median(y))
    assert model.start == pytest.approx(np.median(y))
    errors = [np.abs(y - so_far).mean()]
    for step, tree in zip(model.steps(), model.trees, strict=True):
        own = [leaf(tree, v) for v in x]
        for node in tree.leaves():
            inside = np.array([n is node for n in own])
            assert node.rows == inside.sum()
            if inside.any():
                assert node.value == pytest.approx(np.median((y - so_far)[inside]), abs=1e-9)
        so_far = so_far + step * np.array([n.value for n in own])
        errors.append(np.abs(y - so_far).mean())
    assert errors[-1] < errors[0] / 2 and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))

    got = {r.k: r.prediction for r in model.predict(rows).collect()}
    assert [got[k] for k in range(600)] == pytest.approx(so_far.tolist(), abs=1e-9)
    model.save(spark, str(tmp_path / "trees"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "trees"))
    assert again == model
    assert boosting.train_absolute(rows.limit(0), "y").trees == []


def test_trees_with_categories_as_expressions(spark):
    from doorclock.operators import boosting

    rows = spark.createDataFrame(
        [(f"k{k}", f"c{k % 7}", float(k % 5), 10.0 + 30.0 * ((k % 7) in (1, 4, 5)) + k % 5) for k in range(400)],
        "order_id string, city string, n double, label double",
    )
    encode = training.fit_tree_encoder(rows, ["city"], ["n"])
    trained = training.train_duration(rows, "label", encode, ["n"], trees=5)
    unseen = spark.createDataFrame([("z", "never", 2.0, 1.0)], rows.schema)
    coded = encode.transform(rows.unionByName(unseen))
    model = boosting.ensemble(trained.model)
    assert any(node.sides and node.categories for tree in model.trees for node in [tree])
    both = trained.model.transform(coded).select("order_id", "features", F.col("prediction").alias("fitted"))
    for r in model.predict(both).collect():
        assert r.prediction == pytest.approx(r.fitted, abs=1e-9)


def test_rounds_do_not_walk_the_trees_of_earlier_rounds(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler

    from doorclock.operators import boosting

    e = F.col("id")
    rows = spark.range(300).select((e % 13).cast("double").alias("a"), (e % 7).cast("double").alias("b"), (e % 13 * (e % 7)).cast("double").alias("y"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)

    def walked(*_):
        raise AssertionError("a round costs as much as all rounds before it")

    with monkeypatch.context() as patch:
        patch.setattr(boosting.BoostedTrees, "expression", walked)
        model = boosting.train_absolute(rows, "y", trees=4, depth=2)
    error = model.predict(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    start = rows.agg(F.avg(F.abs(F.lit(model.start) - F.col("y")))).first()[0]
    assert len(model.trees) == 4 and error < start


def test_a_level_of_a_tree_looks_its_node_up_once(spark):
    from doorclock.operators import boosting

    leaf = [boosting.Node(float(k)) for k in range(4)]
    sides = (boosting.Node(0.0, feature=1, categories=(1.0, 3.0), sides=(leaf[0], leaf[1])), boosting.Node(0.0, feature=0, threshold=9.0, sides=(leaf[2], leaf[3])))
    model = boosting.BoostedTrees(0.0, 1.0, [boosting.Node(0.0, feature=0, threshold=5.0, sides=sides), leaf[3]])
    rows = spark.createDataFrame([([5.0, 3.0], 3.0), ([5.0, 2.0], 4.0), ([9.0, 1.0], 5.0), ([9.5, 1.0], 6.0)], "x array<double>, expected double")
    found = rows.select(model.expression(F.col("x")).alias("found"), "expected")
    assert all(r.found == r.expected for r in found.collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("element_at") == 2  # the root and a level's node


def test_learning_reads_equal_shares(spark, rows, monkeypatch):
    taken = []
    fit = training.GBTRegressor.fit
    monkeypatch.setattr(training.GBTRegressor, "fit", lambda self, table: taken.append(table) or fit(self, table))
    uneven = rows.coalesce(1)
    training.train_duration(uneven, "label", training.fit_encoder(uneven, ["city"], ["x"]), ["x"], trees=1)
    shares = [len(part) for part in taken[0].rdd.glom().collect()]
    assert len(shares) == spark.sparkContext.defaultParallelism and sum(shares) == 600
    assert max(shares) - min(shares) <= 1
