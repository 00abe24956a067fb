"""Error reports, two-class metrics, sampling and running totals against plain Python or numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doorclock.operators import binary, errors, sampling
from doorclock.operators.prefix import dense_ids, falling_totals, running_totals


def report(spark, rows, segments=None):
    df = spark.createDataFrame(rows, "p double, m double, g string")
    return {r["segment"]: r.asDict() for r in errors.error_report(df, F.col("p"), F.col("m"), segments).collect()}


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_error_report_agrees_with_numpy(spark, n):
    rng = np.random.default_rng(n)
    measured = rng.integers(1, 900, n).astype(float)
    # A third of the errors are equal, some are zero, a few are huge.
    predicted = np.where(rng.random(n) < 0.34, measured + 25.0, measured + rng.normal(0, 200, n))
    predicted[:: 50] = measured[:: 50]
    predicted[3:: 97] += 1e6
    got = report(spark, [(float(p), float(m), "x") for p, m in zip(predicted, measured)])["all"]
    error = np.abs(predicted - measured)
    relative = error / measured
    assert got["n"] == n and got["mean_error_s"] == int(error.mean())
    for p in (50, 67, 80, 95):
        assert got[f"p{p}"] == pytest.approx(np.percentile(error, p), abs=0.0501)
    assert got["p50"] <= got["p67"] <= got["p80"] <= got["p95"]
    for t in (30, 50, 70):
        assert got[f"over{t}_pct"] == pytest.approx((relative > t / 100).mean() * 100, abs=0.0501)
    assert got["mape_pct"] == pytest.approx(relative.mean() * 100, abs=0.0501, rel=1e-6)


def test_percentiles_are_exact(spark):
    values = [random.Random(1).expovariate(0.01) for _ in range(999)] + [17.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = errors.exact_percentiles(df, F.col("v"), (0.0, 0.25, 0.5, 0.999, 1.0)).first()
    expected = np.percentile(values, [0, 25, 50, 99.9, 100])
    assert [got[c] for c in ("p0", "p25", "p50", "p100")] == pytest.approx(
        [expected[0], expected[1], expected[2], expected[4]], rel=1e-12
    )


def test_segments_overlap_and_odd_rows(spark):
    rows = [(10.0, 10.0, "a"), (30.0, 10.0, "a"), (5.0, 0.0, "b"), (None, 10.0, "b"), (12.0, 10.0, "b")]
    got = report(spark, rows, {"all": F.lit(True), "a": F.col("g") == "a", "b": F.col("g") == "b"})
    assert (got["all"]["n"], got["a"]["n"], got["b"]["n"]) == (4, 2, 2)
    assert got["a"]["p50"] == 10.0 and got["a"]["over30_pct"] == 50.0
    assert got["b"]["n_zero_truth"] == 1 and got["b"]["mape_pct"] == 20.0


def scored_rows(n=600):
    rng = random.Random(3)
    return [(i, 1 if rng.random() < 0.3 else -1, rng.randrange(0, 101) / 101) for i in range(n)]


def test_binary_metrics(spark):
    rows = scored_rows()
    df = spark.createDataFrame(rows, "id long, label int, score double")
    got = binary.binary_metrics(df).first()
    tp = sum(label == 1 and s >= 0.5 for _, label, s in rows)
    fp = sum(label == -1 and s >= 0.5 for _, label, s in rows)
    pos = sum(label == 1 for _, label, _ in rows)
    assert got["precision"] == tp / (tp + fp) and got["recall"] == tp / pos
    plus = [s for _, label, s in rows if label == 1]
    minus = [s for _, label, s in rows if label == -1]
    wins = sum((a > b) + (a == b) / 2 for a in plus for b in minus)
    assert got["auc"] == pytest.approx(wins / len(plus) / len(minus), rel=1e-12)
    none = binary.binary_metrics(df, threshold=2.0).first()
    assert none["precision"] == 0.0 and none["recall"] == 0.0


def test_sweep_adds_up(spark):
    rows = scored_rows()
    got = binary.threshold_sweep(spark.createDataFrame(rows, "id long, label int, score double")).collect()
    assert [r["prob"] for r in got] == [round(0.05 * i, 2) for i in range(1, 20)]
    assert all(r["neg_num"] + r["pos_num"] == len(rows) for r in got)
    for r in got:
        t = [x for x in binary.SWEEP if round(x, 2) == r["prob"]][0]
        assert r["pos_num"] == sum(s >= t for _, _, s in rows)


def test_roc_runs_from_origin_to_one(spark):
    points = binary.roc_points(spark.createDataFrame(scored_rows(), "id long, label int, score double"))
    got = sorted((r["fpr"], r["tpr"]) for r in points.collect())
    assert got[0] == (0.0, 0.0) and got[-1] == (1.0, 1.0)
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))


def test_running_totals_and_ids(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1000), rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, v long")
    got = running_totals(df, F.floor(F.col("k") / 100), [F.col("k"), F.col("id")], {"v": "total"})
    total, expected = 0, {}
    for i, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        expected[i] = total
    assert {r["id"]: r["total"] for r in got.collect()} == expected
    numbered = dense_ids(df.select(F.col("id").alias("key")), "key")
    assert sorted(r["id"] for r in numbered.collect()) == list(range(1, 501))


def test_split_and_balance(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 5 == 0, 1).otherwise(-1).alias("label"))
    train, test = sampling.train_test(df, "id")
    assert train.count() + test.count() == 5000 and abs(train.count() - 4000) < 150
    assert train.join(test, "id").isEmpty()
    rule = sampling.balance_ratio(df).first()
    assert (rule["sample_type"], rule["ratio"]) == (-1, 0.25)
    kept = sampling.undersampled(df, "id")
    counts = {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}
    assert counts[1] == 1000 and abs(counts[-1] - 1000) < 120
    even = df.where("id % 5 < 2").withColumn("label", F.when(F.col("id") % 5 == 0, 1).otherwise(-1))
    assert sampling.balance_ratio(even).first()["sample_type"] == 0
    assert sampling.undersampled(even, "id").count() == even.count()


def test_percentiles_of_negative_values_and_odd_ones(spark):
    values = [-7.0, -5.5, -5.5, -1.0, 0.0, 0.5, 9.0, -1e6]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    got = errors.exact_percentiles(df, F.col("v"), (0.1, 0.5, 0.9)).first()
    assert [got.p10, got.p50, got.p90] == pytest.approx(np.percentile(values, [10, 50, 90]).tolist())


def test_missing_predictions_are_counted(spark):
    got = report(spark, [(1.0, 2.0, "a"), (None, 2.0, "a"), (3.0, None, "a"), (5.0, 0.0, "a")])["all"]
    assert (got["n"], got["n_missing"], got["n_zero_truth"]) == (2, 2, 1)


@pytest.mark.parametrize("low, width", [(1e-4, 1e-6), (-50.0, 100.0)])
def test_close_scores_and_margins_spread_over_ranges(spark, low, width):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, -1]), low + width * rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    plus, minus = ([s for _, label, s in rows if label == k] for k in (1, -1))
    order = np.sort(minus)
    wins = sum(np.searchsorted(order, s) for s in plus)
    assert binary.auc(df).first().auc == pytest.approx(wins / len(plus) / len(minus), rel=1e-9)
    counts = falling_totals(df.groupBy("score").count(), "score", {"count": "through"}).withColumn("at", F.spark_partition_id())
    assert counts.where("through = 4000").count() == 1
    points = binary.roc_points(df)
    assert points.agg(F.max("tp"), F.max("fp")).first() == (len(plus), len(minus))
