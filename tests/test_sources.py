from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog.pipelines import pickup_sample
from doorclock import schemas
from doorclock.operators import features
from doorclock.plans import staging, training
from doorclock.sources import delimited, sinks


def test_read_samples(spark, tmp_path):
    path = tmp_path / "sample.txt"
    path.write_text("1\t2\tNULL\n\n4,5,Null\n 7  8   9 \nonly\n", encoding="utf-8")
    got = delimited.read_samples(spark, str(path), ["a", "b", "c"], until_blank=False).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [("1", "2", "-1"), ("4", "5", "-1"), ("7", "8", "9"), ("only", None, None)], key=str
    )
    assert [r.a for r in delimited.read_samples(spark, str(path), ["a"], limit=1).collect()] == ["1"]
    assert [r.a for r in delimited.read_samples(spark, str(path), ["a"]).collect()] == ["1"]  # a blank line ends the file


def test_read_evaluation(spark, tmp_path):
    path = tmp_path / "mini.csv"
    path.write_text("test_id,isdowngrade,a2_time,pickuptimevalue,other\nnew,1,60,70,x\nblank,0,50,NULL,y\n")
    rows = delimited.read_evaluation(spark, str(path), "pickuptimevalue", "a2_time").collect()
    assert [tuple(r) for r in rows] == [(1, "new", 70.0, 60.0), (0, "blank", None, 50.0)]


def test_export_keeps_features(spark, tiny, tmp_path):
    """A sample read back from its text export gives the features of the table."""
    table = sinks.replace_table(pickup_sample(spark, tiny), str(tmp_path / "table"))
    sinks.export_tsv(table, str(tmp_path / "text"))
    back = delimited.read_samples(spark, str(tmp_path / "text"), schemas.PICKUP_SAMPLE)
    direct = features.pickup_features(features.with_null_flags(table))
    again = features.pickup_features(back)
    assert direct.count() > 0
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, again.collect()))
    lines = spark.read.text(str(tmp_path / "text"))
    quality = training.read_quality(lines, again).first()
    assert quality["n_lines"] == table.count() and quality["n_failed"] == table.count() - direct.count()


def test_publish_refuses_duplicate_keys(spark, tmp_path):
    rows = [(1, 3, 5.0), (2, 3, 6.0)]
    df = spark.createDataFrame(rows, "supplier_id long, city_id int, avg_a1_time double")
    table = sinks.publish(df, schemas.SUPPLIER_HISTORY, ["supplier_id"], str(tmp_path / "ok"))
    assert table.columns == list(schemas.SUPPLIER_HISTORY)
    assert {r["avg_a2_time"] for r in table.collect()} == {0.0}
    with pytest.raises(ValueError):
        sinks.publish(df.union(df), schemas.SUPPLIER_HISTORY, ["supplier_id"], str(tmp_path / "bad"))


def test_older_names(spark):
    df = spark.createDataFrame([(1, 2)], "deliver_time1 long, deliver_time2 long")
    assert schemas.modern_names(df).columns == ["delivery_time1", "delivery_time2"]


def test_partition_pruning_reaches_the_scan(spark, tiny, tmp_path):
    from doorclock import fixtures as fx
    from doorclock import settings as S
    from doorclock.sources import tables

    orders = sinks.replace_table(
        fx.orders(fx.trips(spark, tiny)).where("create_dt < '2024-01-05'"), str(tmp_path / "o"), ["create_dt"]
    )
    scanned = tables.order_scan(
        orders.withColumn("create_dt", F.col("create_dt").cast("string")),
        S.DateRange("2024-01-02", "2024-01-03"),
        "UTC",
    )
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(create_dt" in plan and "order_status" in plan.split("PushedFilters")[1]
    assert {str(r[0]) for r in scanned.select("create_dt").distinct().collect()} == {"2024-01-02", "2024-01-03"}


def test_rating_lines_keep_null_words(spark):
    lines = spark.createDataFrame([("1\tNULL\tNone",)], "value string")
    assert tuple(delimited.parse_lines(lines, ["a", "b", "c"], mask_nulls=False).first()) == ("1", "NULL", "None")
    assert tuple(delimited.parse_lines(lines, ["a", "b", "c"]).first()) == ("1", "-1", "-1")


def test_prepared_sample_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "city string, n double")
    encode = training.fit_encoder(rows, ["city"], ["n"])
    sinks.save_prepared(rows, encode, str(tmp_path), "small")
    again, loaded = sinks.load_prepared(spark, str(tmp_path), "small")
    assert sorted(again.collect()) == sorted(rows.collect())
    assert sorted(map(str, loaded.transform(again).collect())) == sorted(map(str, encode.transform(rows).collect()))


def test_coefficient_lines(spark, tmp_path):
    df = spark.createDataFrame([("b=1", 0.5), ("a", -2.0)], "feature string, value double")
    sinks.save_coefficients(df, str(tmp_path / "coef"))
    assert [r.value for r in spark.read.text(str(tmp_path / "coef")).collect()] == ["b=1\t0.5", "a\t-2.0"]


class Session:
    """As much of a session as the choice of a stage folder reads."""

    def __init__(self, master, **conf):
        self.sparkContext, self.master = self, master
        self.conf = self
        self._conf = conf

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self._conf.get(key.replace(".", "_"), default)


def test_stage_folder():
    assert staging.stage_folder(Session("yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert staging.stage_folder(Session("yarn", spark_checkpoint_dir="file:///mnt/shared")) == "file:///mnt/shared"
    assert staging.stage_folder(Session("local[4]", spark_sql_warehouse_dir="file:/w")) == "file:/w/_stages"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            staging.stage_folder(Session(master))


def test_staged_tables_are_read_back_and_dropped(spark, tmp_path):
    table = staging.staged(spark.range(5).selectExpr("id", "cast(null as string) as t"), "five")
    files = table.inputFiles()
    assert table.count() == 5 and files
    staging.dropped(table)
    assert not any(Path(f.removeprefix("file://")).exists() for f in files)


def test_prepared_samples_by_fingerprint(spark, tmp_path):
    from doorclock.sources import prepared

    source, folder = tmp_path / "in", str(tmp_path / "kept")
    spark.createDataFrame([("x", 1.0), ("y", 2.0)], "city string, n double").write.parquet(str(source))
    calls = []

    def run(parameters, fail=False):
        def prepare():
            calls.append(parameters)
            rows = spark.read.parquet(str(source)).where(F.col("n") >= parameters["least"])
            if fail:
                rows = rows.withColumn("n", F.raise_error(F.lit("lost")).cast("double"))
            return rows, training.fit_encoder(spark.read.parquet(str(source)), ["city"], ["n"])

        return prepared.prepared_sample(spark, folder, "s", [str(source)], parameters, [features], prepare)

    with pytest.raises(Exception, match="lost"):
        run({"least": 1}, fail=True)
    first, again, other = run({"least": 1}), run({"least": 1}), run({"least": 2})
    assert (first.reused, again.reused, other.reused) == (False, True, False)
    assert first.name == again.name != other.name and len(calls) == 3
    assert (again.rows.count(), other.rows.count()) == (2, 1)
    spark.createDataFrame([("z", 3.0)], "city string, n double").write.mode("append").parquet(str(source))
    later = run({"least": 1})
    assert not later.reused and later.rows.count() == 3
    assert prepared.fingerprint("a", {"x": 1}, "c") != prepared.fingerprint("a", {"x": 1}, "d")
