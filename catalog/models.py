"""Features, two-class metrics and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.pipelines import _REPORT, handover_sample, pickup_sample
from catalog.registry import query
from doorclock import fixtures as fx
from doorclock import settings as S
from doorclock.operators import binary, boosting, encoding, errors, features, sampling
from doorclock.plans import training
from doorclock.functions import scaling
from doorclock.plans.staging import stage_folder, staged
from doorclock.schemas import RATING_SAMPLE
from doorclock.sources import prepared, sinks
from doorclock.sources.delimited import parse_lines

A_ROUNDS = {
    "real_time_line_distance": 3,
    "old_a1": 3,
    "old_a2": 6,
    **{f"{p}_avg_{a}_time": 6 for p in "ts" for a in ("a1", "a2")},
}
C_ROUNDS = {
    "std_distance_poi": 6,
    "std_delivery_time_poi": 6,
    "t_avg_a1_time": 6,
    "t_avg_a2_time": 6,
}
RATING_ROUNDS = {c: 6 for c in features.RATING_NUMBERS}


def _handover_rows(spark, sf):
    return features.handover_features(features.with_null_flags(handover_sample(spark, sf)))


def _pickup_rows(spark, sf):
    return features.pickup_features(features.with_null_flags(pickup_sample(spark, sf)))


def _rating_rows(spark, sf):
    lines = fx.rating_lines(fx.trips(spark, sf))
    return features.rating_features(parse_lines(lines, RATING_SAMPLE, mask_nulls=False))


@query("c_features", "select * from f_handover", C_ROUNDS)
def c_features(spark, sf):
    return _handover_rows(spark, sf)


@query("a_features", "select * from f_pickup", A_ROUNDS)
def a_features(spark, sf):
    return _pickup_rows(spark, sf)


@query(
    "baseline_estimates",
    "select delivery_id, old_a1, old_a2 from f_pickup",
    {"old_a1": 3, "old_a2": 6},
)
def baseline_estimates(spark, sf):
    return _pickup_rows(spark, sf).select("delivery_id", "old_a1", "old_a2")


@query(
    "error_short_distance",
    _REPORT.format(
        rows="""select 'all' as segment, old_a1 as predicted, label_a1 as measured from f_pickup
      union all select 'short', old_a1, label_a1 from f_pickup where real_time_line_distance <= 200"""
    ),
)
def error_short_distance(spark, sf):
    rows = staged(_pickup_rows(spark, sf), "pickup-features")
    return errors.error_report(
        rows,
        F.col("old_a1"),
        F.col("label_a1"),
        errors.short_distance_segments(S.SHORT_DISTANCE_M),
    )


@query("legacy_features", "select * from f_rating", RATING_ROUNDS)
def legacy_features(spark, sf):
    return _rating_rows(spark, sf)


@query(
    "feature_crossing",
    "select delivery_id, city_id, hour, city_id || '_' || hour as city_id_hour from f_pickup",
)
def feature_crossing(spark, sf):
    rows = _pickup_rows(spark, sf).select("delivery_id", "city_id", "hour")
    return features.crossed(rows, {"city_id": "hour"})


@query(
    "class_counts",
    """select count(*) as num, count(*) filter (label = 1) as pos, count(*) filter (label = -1) as neg,
      count(distinct grade) + count(distinct work_dt_cnt) + count(distinct not_first_invalid) + 5 as dimension
    from f_rating""",
)
def class_counts(spark, sf):
    rows = _rating_rows(spark, sf)
    categories = [F.count_distinct(c) for c in features.RATING_CATEGORIES]
    dimension = rows.agg(sum(categories, F.lit(len(features.RATING_NUMBERS)))).scalar()
    return binary.class_counts(rows).withColumn("dimension", dimension)


@query(
    "balance_ratio",
    """select pos, neg, case when even then 0 when pos >= neg then 1 else -1 end as sample_type,
      case when even then -1e0 when pos >= neg then neg / pos else pos / neg end as ratio
    from (select *, abs(pos - neg) / (pos + neg) < 0.05 as even from (
      select count(*) filter (label = 1) as pos, count(*) filter (label = -1) as neg from d_scored))""",
    {"ratio": 9},
)
def balance_ratio(spark, sf):
    return sampling.balance_ratio(fx.scored(fx.trips(spark, sf)))


@query(
    "undersample",
    """select order_id, label, score from d_scored, (
      select count(*) filter (label = 1) as pos, count(*) filter (label = -1) as neg from d_scored)
    where label = 1 or cast('0x' || substr(md5(order_id || 'balance'), 1, 7) as bigint) / 268435456e0 <= pos / neg""",
    {"score": 9},
)
def undersample(spark, sf):
    return sampling.undersampled(fx.scored(fx.trips(spark, sf)), "order_id")


_AUC = """(select sum(n_neg * (above + n_pos / 2e0)) / (sum(n_pos) * sum(n_neg)) from (
      select score, n_pos, n_neg, coalesce(sum(n_pos) over (order by score desc rows between unbounded preceding and 1 preceding), 0) as above
      from (select score, count(*) filter (label = 1) as n_pos, count(*) filter (label = -1) as n_neg from d_scored group by score)))"""


@query(
    "binary_metrics",
    f"""select count(*) as num, count(*) filter (label = 1) as pos, count(*) filter (label = -1) as neg,
      avg(case when (score >= 0.5) = (label = 1) then 1e0 else 0e0 end) as accuracy,
      count(*) filter (score >= 0.5 and label = 1) / count(*) filter (score >= 0.5) as precision,
      count(*) filter (score >= 0.5 and label = 1) / count(*) filter (label = 1) as recall, {_AUC} as auc
    from d_scored""",
    {"accuracy": 9, "precision": 9, "recall": 9, "auc": 9},
)
def binary_metrics(spark, sf):
    return binary.binary_metrics(fx.scored(fx.trips(spark, sf)))


@query(
    "threshold_sweep",
    f"""select round(i * 0.05e0, 2) as prob, count(*) filter (score < i * 0.05e0) as neg_num,
      count(*) filter (score >= i * 0.05e0) as pos_num,
      count(*) filter (score >= i * 0.05e0) / count(*) as pk_ratio,
      avg(case when (score >= i * 0.05e0) = (label = 1) then 1e0 else 0e0 end) as accuracy,
      count(*) filter (score >= i * 0.05e0 and label = 1) / count(*) filter (score >= i * 0.05e0) as precision,
      count(*) filter (score >= i * 0.05e0 and label = 1) / count(*) filter (label = 1) as recall, {_AUC} as auc
    from d_scored, (select unnest(range(1, 20)) as i) group by i""",
    {"pk_ratio": 9, "accuracy": 9, "precision": 9, "recall": 9, "auc": 9},
)
def threshold_sweep(spark, sf):
    return binary.threshold_sweep(fx.scored(fx.trips(spark, sf)))


@query(
    "roc_points",
    """select null::double as threshold, cast(0 as bigint) as fp, cast(0 as bigint) as tp, 0e0 as fpr, 0e0 as tpr
    union all
    select score, fp, tp, fp / (select count(*) from d_scored where label = -1), tp / (select count(*) from d_scored where label = 1)
    from (select score, cast(sum(n_neg) over w as bigint) as fp, cast(sum(n_pos) over w as bigint) as tp
      from (select score, count(*) filter (label = 1) as n_pos, count(*) filter (label = -1) as n_neg from d_scored group by score)
      window w as (order by score desc))""",
    {"threshold": 9, "fpr": 9, "tpr": 9},
)
def roc_points(spark, sf):
    return binary.roc_points(fx.scored(fx.trips(spark, sf)))


@query(
    "threshold_report",
    f"""select '  prob   neg_num   pos_num    pk_ratio    accuracy   precison  recall       auc' as value
    union all
    select printf('%6.2f%10d%10d%10.2f%%%10.2f%%%10.2f%%%10.2f%%%10.4f', i * 0.05e0, count(*) filter (score < i * 0.05e0),
      count(*) filter (score >= i * 0.05e0), 100e0 * count(*) filter (score >= i * 0.05e0) / count(*),
      100e0 * avg(case when (score >= i * 0.05e0) = (label = 1) then 1e0 else 0e0 end),
      100e0 * count(*) filter (score >= i * 0.05e0 and label = 1) / count(*) filter (score >= i * 0.05e0),
      100e0 * count(*) filter (score >= i * 0.05e0 and label = 1) / count(*) filter (label = 1), {_AUC})
    from d_scored, (select unnest(range(1, 20)) as i) group by i""",
)
def threshold_report(spark, sf):
    return sinks.threshold_lines(binary.threshold_sweep(fx.scored(fx.trips(spark, sf))))


_PAIRS = "\n      union all ".join(
    f"select '{c}=' || {c} as feature, cast(count(*) as double) as value from f_pickup group by {c}"
    for c in features.PICKUP_CATEGORIES
)


@query(
    "onehot_counts",
    f"select feature, cast(value as bigint) as n_nonzero, value as total from ({_PAIRS})\n      union all "
    + "\n      union all ".join(
        f"select '{c}', count(*) filter ({c} <> 0), sum({c}) from f_pickup"
        for c in features.PICKUP_NUMBERS
    ),
    {"total": 3},
)
def onehot_counts(spark, sf):
    rows = staged(_pickup_rows(spark, sf), "pickup-features")
    model = training.fit_encoder(rows, features.PICKUP_CATEGORIES, features.PICKUP_NUMBERS)
    return encoding.encoded_totals(model, rows, features.PICKUP_NUMBERS)


@query(
    "top_features",
    f"select feature, value from ({_PAIRS}) order by value desc, feature limit 20",
)
def top_features(spark, sf):
    pairs = F.explode(
        F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in features.PICKUP_CATEGORIES])
    )
    counts = (
        _pickup_rows(spark, sf)
        .select(pairs.alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    return encoding.top_features(counts)


def _trained_handover(spark, sf):
    """Rows and the duration model trained on four fifths of them."""
    rows = staged(_handover_rows(spark, sf), "handover-features")
    train, _ = sampling.train_test(rows, "order_id")
    numbers = features.HANDOVER_NUMBERS
    encode = training.fit_tree_encoder(rows, features.HANDOVER_CATEGORIES, numbers)
    return rows, training.train_duration(train, "label", encode, numbers)


@query(
    "gbt_train_score",
    """select order_id, case when cast('0x' || substr(md5(order_id), 1, 7) as bigint) % 100 < 80 then 'train' else 'test' end as split,
      label, true as is_finite, true as is_positive from f_handover""",
)
def gbt_train_score(spark, sf):
    """Trained on four fifths of the hand-over rows; every row scored.

    The predictions themselves depend on the learner; their presence, range and split do not.
    """
    rows, trained = _trained_handover(spark, sf)
    predicted = F.col("predicted")
    return training.score_duration(trained.pipeline, rows).select(
        "order_id", sampling.split_name(F.col("order_id")).alias("split"), "label",
        (predicted.isNotNull() & ~F.isnan(predicted) & (F.abs(predicted) < float("inf"))).alias("is_finite"),
        (predicted > 0).alias("is_positive"),
    )


@query(
    "gbt_beats_median",
    """select 'train' as split, count(*) as n, true as beats_median from f_handover
    where cast('0x' || substr(md5(order_id), 1, 7) as bigint) % 100 < 80""",
)
def gbt_beats_median(spark, sf):
    """On the rows it was trained on: is the mean absolute error below that of their median?"""
    rows, trained = _trained_handover(spark, sf)
    train, _ = sampling.train_test(rows, "order_id")
    scored = training.score_duration(trained.pipeline, train).withColumn("split", F.lit("train"))
    scored = staged(scored.select("split", "label", "predicted"), "scored")
    median = errors.exact_percentiles(scored, F.col("label"), (0.5,)).select("p50").scalar()
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.abs(F.col("predicted") - F.col("label"))) < F.avg(F.abs(median - F.col("label")))).alias("beats_median"),
    )


TREES = 6
_SPLIT = "case when cast('0x' || substr(md5(order_id), 1, 7) as bigint) % 100 < 80 then 'train' else 'test' end"


def _small_models(spark, sf):
    """Encoded rows, and both kinds of boosted trees with few rounds on the same training rows."""
    rows = staged(_handover_rows(spark, sf).select("order_id", "label", *features.HANDOVER_CATEGORIES, *features.HANDOVER_NUMBERS), "handover-features")
    encode = training.fit_tree_encoder(rows, features.HANDOVER_CATEGORIES, features.HANDOVER_NUMBERS)
    coded = staged(encode.transform(rows).select("order_id", "label", "features"), "handover-encoded")
    return rows, encode, coded, sampling.train_test(coded, "order_id")[0]


def _scored_thrice(spark, sf):
    """A fitted pipeline's prediction, the one of the pipeline saved and loaded, and the expression's."""
    rows, encode, _, train = _small_models(spark, sf)
    trained = training.train_duration(train, "label", encode, features.HANDOVER_NUMBERS, trees=TREES)
    path = f"{stage_folder(spark)}/model-{uuid.uuid4().hex}"
    sinks.save_model(trained.pipeline, path)
    scored = training.score_duration(trained.pipeline, rows).withColumnRenamed("predicted", "fitted")
    scored = training.score_duration(sinks.load_model(path), scored).withColumnRenamed("predicted", "loaded")
    by_expression = boosting.ensemble(trained.model).predict(encode.transform(scored))
    return by_expression.withColumn("expression", scaling.expand(F.col("prediction")))


@query("gbt_scores")
def gbt_scores(spark, sf):
    """Every hand-over row with its predicted seconds, by the fitted model, the loaded one and the expression."""
    return _scored_thrice(spark, sf).select(
        "order_id", sampling.split_name(F.col("order_id")).alias("split"), "label", F.col("fitted").alias("predicted"), "loaded", "expression"
    )


@query("gbt_scores_agree", "select order_id, label, true as loaded_agrees, true as expression_agrees from f_handover")
def gbt_scores_agree(spark, sf):
    fitted = F.col("fitted")
    return _scored_thrice(spark, sf).select(
        "order_id", "label", (F.abs(F.col("loaded") - fitted) <= 1e-9).alias("loaded_agrees"),
        (F.abs(F.col("expression") - fitted) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(fitted))).alias("expression_agrees"),
    )


def _leaf_values(spark, sf):
    """Trees of exact leaf medians, and the same medians computed once more from the finished model."""
    _, encode, _, train = _small_models(spark, sf)
    model = training.train_duration_medians(train, "label", encode, trees=TREES)
    target = train.select("features", scaling.compress(F.col("label")).alias("target"))
    nodes, checks = [], []
    for k, tree in enumerate(model.trees):
        nodes += [(k, i, leaf.rows, leaf.value) for i, leaf in enumerate(tree.leaves())]
        before = boosting.BoostedTrees(model.start, model.step, model.trees[:k])
        numbered = tree.with_leaves(iter([boosting.Node(float(i)) for i, _ in enumerate(tree.leaves())]))
        only = boosting.BoostedTrees(0.0, 1.0, [numbered])
        rows = boosting.predicted_by(
            target, lambda x, b=before, o=only: F.struct(b.expression(x).alias("so_far"), o.expression(x).alias("leaf")), name="found"
        )
        residual = F.col("target") - F.col("found.so_far")
        checks.append(
            rows.groupBy(F.lit(k).alias("tree"), F.col("found.leaf").cast("int").alias("leaf")).agg(
                F.percentile(residual, 0.5).alias("median"), F.count(F.lit(1)).alias("n_again")
            )
        )
    known = spark.createDataFrame(nodes, "tree int, leaf int, n long, value double").where("n > 0")
    again = checks[0]
    for more in checks[1:]:
        again = again.unionByName(more)
    return known.join(again, ["tree", "leaf"], "full")


@query("lad_leaf_values")
def lad_leaf_values(spark, sf):
    return _leaf_values(spark, sf).select("tree", "leaf", "n", "median", "value")


@query(
    "lad_leaf_check",
    f"""select cast(tree as int) as tree, count(*) as n, true as counts_agree, true as values_are_medians
    from f_handover, (select unnest(range(0, {TREES})) as tree) where {_SPLIT} = 'train' group by tree""",
)
def lad_leaf_check(spark, sf):
    """Per tree: rows in its leaves, and whether each leaf's value is the median of its residuals."""
    return _leaf_values(spark, sf).groupBy("tree").agg(
        F.sum("n").alias("n"), F.min(F.coalesce(F.col("n") == F.col("n_again"), F.lit(False))).alias("counts_agree"),
        F.min(F.coalesce(F.abs(F.col("value") - F.col("median")) <= 1e-9, F.lit(False))).alias("values_are_medians"),
    )


@query(
    "lad_beats_signs",
    f"select 'train' as split, count(*) as n, true as lower_error from f_handover where {_SPLIT} = 'train'",
)
def lad_beats_signs(spark, sf):
    """On the training rows: leaf medians give a lower mean absolute error than averages of signs."""
    _, encode, _, train = _small_models(spark, sf)
    signs = boosting.ensemble(training.train_duration(train, "label", encode, features.HANDOVER_NUMBERS, trees=TREES).model)
    # A median is the best step of its leaf, so that it can be taken in full.
    medians = training.train_duration_medians(train, "label", encode, trees=TREES, step=1.0)
    target = train.select("features", scaling.compress(F.col("label")).alias("target"))
    both = medians.predict(signs.predict(target, name="by_signs"), name="by_medians")
    error = {c: F.avg(F.abs(F.col(c) - F.col("target"))) for c in ("by_signs", "by_medians")}
    return both.agg(
        F.lit("train").alias("split"), F.count(F.lit(1)).alias("n"), (error["by_medians"] < error["by_signs"]).alias("lower_error")
    )


@query(
    "gbt_pickup_report",
    """select model, split as segment, count(*) as n, count(*) filter (false) as n_missing, true as ordered from (
      select case when cast('0x' || substr(md5(delivery_id), 1, 7) as bigint) % 100 < 80 then 'train' else 'test' end as split,
        unnest(['a1', 'a2']) as model from f_pickup) group by model, split""",
)
def gbt_pickup_report(spark, sf):
    """Both pick-up models: trained on four fifths of the rows, their errors on either part."""
    rows = staged(_pickup_rows(spark, sf), "pickup-features")
    train, _ = sampling.train_test(rows, "delivery_id")
    numbers = features.PICKUP_NUMBERS
    encode = training.fit_tree_encoder(rows, features.PICKUP_CATEGORIES, numbers)
    report = training.pickup_report(training.train_pickup(train, encode, numbers), rows)
    figures = [F.col(c) for c in ("p50", "p67", "p80", "p95")]
    ordered = (figures[0] >= 0) & (figures[0] <= figures[1]) & (figures[1] <= figures[2]) & (figures[2] <= figures[3])
    return report.select("model", "segment", "n", "n_missing", ordered.alias("ordered"))


@query(
    "sample_read_quality",
    """select count(*) as n_lines, count(*) - (select count(*) from f_rating) as n_failed
    from d_rating""",
)
def sample_read_quality(spark, sf):
    lines = fx.rating_lines(fx.trips(spark, sf))
    return training.read_quality(lines, _rating_rows(spark, sf))


def _trained_rating(spark, sf):
    rows = staged(_rating_rows(spark, sf), "rating-features")
    numbers = features.RATING_NUMBERS
    encode = training.fit_encoder(rows, features.RATING_CATEGORIES, numbers)
    return rows, training.train_rating(rows, encode, numbers)


_RATING_NAMES = "\n      union all ".join(
    [f"select distinct '{c}=' || {c} as feature from f_rating" for c in features.RATING_CATEGORIES]
    + [f"select '{c}'" for c in features.RATING_NUMBERS]
    + ["select '(bias)'"]
)


@query("lr_coefficients", f"select feature, true as at_optimum from ({_RATING_NAMES})")
def lr_coefficients(spark, sf):
    """Every coefficient of the regression, and whether the penalised loss is flat there.

    The loss is convex, so that is what makes the coefficients the right ones.
    """
    rows, trained = _trained_rating(spark, sf)
    return training.gradient(trained, rows).select("feature", (F.abs("slope") < 1e-3).alias("at_optimum"))


@query("lr_train_score", "select transporter_id, label, true as in_range from f_rating")
def lr_train_score(spark, sf):
    """Trained on the courier-rating rows; every row scored."""
    rows, trained = _trained_rating(spark, sf)
    scored = training.score_rating(trained.pipeline, rows)
    return scored.select("transporter_id", "label", F.col("prob").between(0, 1).alias("in_range"))


@query("lr_scores")
def lr_scores(spark, sf):
    """Every courier-rating row with its probability, by the fitted pipeline and by the expression."""
    rows, trained = _trained_rating(spark, sf)
    scored = training.score_rating(trained.pipeline, trained.pipeline.transform(rows).select(*rows.columns, F.col("features").alias("coded")))
    by_expression = boosting.predicted_by(scored, lambda x: boosting.logistic_expression(trained.model, x), "coded", "expression")
    return by_expression.select("transporter_id", "label", "prob", "expression")


@query("lr_scores_agree", "select transporter_id, label, true as expression_agrees from f_rating")
def lr_scores_agree(spark, sf):
    return lr_scores(spark, sf).select("transporter_id", "label", (F.abs(F.col("prob") - F.col("expression")) <= 1e-9).alias("expression_agrees"))


@query("coefficients_read_back", f"select feature, true as equal from ({_RATING_NAMES}) where feature <> '(bias)'")
def coefficients_read_back(spark, sf):
    """The text file of coefficients, read again and compared with the model."""
    rows, trained = _trained_rating(spark, sf)
    known = training.coefficients(trained, rows)
    path = f"{stage_folder(spark)}/coefficients-{uuid.uuid4().hex}"
    sinks.save_coefficients(known, path)
    fields = F.split("value", "\t")
    back = spark.read.text(path).select(F.get(fields, 0).alias("feature"), F.get(fields, 1).cast("double").alias("read"))
    return known.join(back, "feature", "full").select("feature", F.coalesce(F.col("read") == F.col("value"), F.lit(False)).alias("equal"))


_PREPARATIONS = [("first", 1, False), ("again", 1, True), ("other parameter", 3, False), ("back", 1, True), ("file added", 1, False)]


@query(
    "prepared_sample_reuse",
    """select cast(run as int) as run, step, reused, cast(case step when 'other parameter' then (select count(*) from f_rating where avg_dis > 0.3e0)
      when 'file added' then 2 * (select count(*) from f_rating) else (select count(*) from f_rating) end as bigint) as n_rows
    from (values """
    + ", ".join(f"({k}, '{step}', {str(reused).lower()})" for k, (step, _, reused) in enumerate(_PREPARATIONS))
    + ") as steps(run, step, reused)",
)
def prepared_sample_reuse(spark, sf):
    """Whether a prepared sample was used again: after nothing, a parameter, or a file has changed."""
    lines = fx.rating_lines(fx.trips(spark, sf))
    path, folder = (f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("sample", "prepared"))
    out = []
    lines.write.text(path)
    for run, (step, tenths, _) in enumerate(_PREPARATIONS):
        if step == "file added":
            lines.write.mode("append").text(path)

        def prepare(least=tenths):
            parsed = parse_lines(spark.read.text(path), RATING_SAMPLE, mask_nulls=False)
            rows = features.rating_features(parsed)
            rows = rows.where(F.col("avg_dis") > least / 10) if least > 1 else rows
            return rows, training.fit_encoder(rows, features.RATING_CATEGORIES, features.RATING_NUMBERS)

        kept = prepared.prepared_sample(spark, folder, "rating", [path], {"least": tenths}, [features, training], prepare)
        out.append(kept.rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(run).alias("run"), F.lit(step).alias("step"), F.lit(kept.reused).alias("reused"), "n_rows"
        ))
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table
