"""Tables kept by day, libraries that roll, merged publication, deviations, and lines in their order."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from catalog.rolling import small_splits
from doorclock import fixtures as fx
from doorclock import schemas
from doorclock import settings as S
from doorclock.operators import history, moments
from doorclock.plans import phase_a, rolling
from doorclock.plans.staging import staged
from doorclock.sources import daily, delimited, sinks


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_daily_runs_keep_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")], "id int, day string")
    daily.replace_days(df.where("day = '2024-01-01'"), path, ["2024-01-01"])
    table = daily.replace_days(df.where("day = '2024-01-02'"), path, ["2024-01-02"])
    assert rows_of(table) == [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")]
    again = daily.replace_days(df.where("id = 3"), path, ["2024-01-02"])
    assert rows_of(again) == [(1, "2024-01-01"), (3, "2024-01-02")]
    assert rows_of(table) == [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")]  # a reader keeps what it has begun with
    assert rows_of(daily.read_days(spark, path, S.DateRange("2024-01-02", "2024-01-09"))) == [(3, "2024-01-02")]
    assert daily.remove_replaced(spark, path) == 1
    assert rows_of(daily.read_days(spark, path)) == [(1, "2024-01-01"), (3, "2024-01-02")]


def test_a_failed_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k, "2024-01-01") for k in range(50)], "id int, day string")
    daily.replace_days(df, path, ["2024-01-01"])
    broken = df.withColumn("id", F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("id") + 100))
    with pytest.raises(Exception, match="lost"):
        daily.replace_days(broken, path, ["2024-01-01"])
    assert rows_of(daily.read_days(spark, path)) == rows_of(df)
    with pytest.raises(ValueError):
        daily.replace_days(df, path, ["2024-01-02"])
    with pytest.raises(ValueError):
        daily.replace_days(df.withColumn("day", F.lit(None).cast("string")), path, ["2024-01-01"])
    assert rows_of(daily.read_days(spark, path)) == rows_of(df)
    daily.replace_days(df.limit(0), path, ["2024-01-01"])
    assert daily.is_empty(spark, path)
    with pytest.raises(FileNotFoundError):
        daily.read_days(spark, path)


def test_a_day_replaced_by_none(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, day string")
    daily.replace_days(df, path, ["2024-01-01", "2024-01-02"])
    daily.replace_days(df.limit(0), path, ["2024-01-01"])
    assert rows_of(daily.read_days(spark, path)) == [(2, "2024-01-02")]
    nothing = daily.read_days(spark, path, S.DateRange("2025-01-01", "2025-01-02"))
    assert nothing.collect() == [] and nothing.columns == ["id", "day"]


def test_windows_equal_the_full_computation(spark, tiny, tmp_path):
    wh = fx.warehouse(spark, tiny)
    folder = str(tmp_path / "lib")
    days = rolling.days_of(S.DateRange("2024-01-01", "2024-01-06"))
    for day in (*days, days[2], days[0]):
        rolling.add_deliveries(wh, folder, S.DateRange(day, day), "UTC")
    for window in (S.DateRange("2024-01-01", "2024-01-04"), S.DateRange("2024-01-03", "2024-01-06"), S.DateRange("2024-01-02", "2024-01-02")):
        for owner in rolling.OWNERS:
            want = phase_a.history_library(wh, window, owner, "UTC")
            got = rolling.history_library(spark, folder, window, owner).select(*want.columns)
            assert rows_of(got) == rows_of(want)


def test_a_run_scans_its_days_only(spark, tiny, tmp_path):
    deliveries = fx.deliveries(fx.trips(spark, tiny)).where("create_dt < '2024-01-06'")
    deliveries.write.partitionBy("create_dt").parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d")).withColumn("create_dt", F.col("create_dt").cast("string"))
    from doorclock.sources import tables

    base = tables.delivery_history_base(stored, S.DateRange("2024-01-03", "2024-01-03"), "UTC", ("create_dt",))
    parts = history.history_parts(base, "supplier_id", "create_dt")
    files = {r[0] for r in base.select(F.input_file_name()).distinct().collect()}
    assert files and all("create_dt=2024-01-03" in f for f in files)
    assert {r.create_dt for r in parts.collect()} == {"2024-01-03"}
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(create_dt" in plan


@pytest.mark.parametrize("offset", [0.0, 1e8, -3e12])
def test_deviation_at_any_offset(spark, offset):
    values = [offset + (k * 37 % 11) / 2 for k in range(200)]
    df = spark.createDataFrame([("a", k % 7, v) for k, v in enumerate(values)] + [("b", 0, offset), ("b", 1, None)], "g string, day int, mean double")
    parts = df.groupBy("g", "day", "mean").agg(F.count(F.lit(1)).alias("n")).withColumn("m2", F.lit(0.0))
    whole = moments.merged_parts(moments.merged_parts(parts, ["g", "day"]), ["g"])
    got = {r.g: r for r in whole.withColumn("dev", moments.deviation(F.col("n"), F.col("m2"))).collect()}
    want = statistics.pstdev([v - offset for v in values])
    assert math.isclose(got["a"].dev, want, rel_tol=1e-3 if abs(offset) > 1e10 else 1e-6)
    assert got["a"].n == 200 and math.isclose(got["a"]["mean"], offset + statistics.fmean([v - offset for v in values]), rel_tol=1e-12, abs_tol=1e-9)
    assert (got["b"].n, got["b"].dev) == (1, 0.0)
    direct = moments.merged_parts(parts, ["g"])
    assert math.isclose({r.g: r.m2 for r in direct.collect()}["a"], got["a"].m2, rel_tol=1e-3)


def published(spark, rows, time):
    df = spark.createDataFrame(rows, "supplier_id long, city_id int, history_order_num long, avg_a1_time double, avg_a2_time double")
    return history.published_history(df, "supplier_id", time)


def test_publication_by_key(spark, tmp_path):
    path, layout, key = str(tmp_path / "p"), schemas.SUPPLIER_HISTORY, schemas.SUPPLIER_HISTORY_KEY
    first = sinks.publish_merged(published(spark, [(1, 1, 5, 1.0, 2.0), (2, 1, 5, 1.0, 2.0), (3, 1, 7, 3.0, None)], "t1"), layout, key, path)
    ids = {r.supplier_id: r.id for r in first.collect()}
    run = published(spark, [(2, 1, 6, 1.5, 2.0), (3, 1, 7, 3.0, None), (4, 9, 1, 0.0, 0.0)], "t2")
    table = sinks.publish_merged(run.withColumn("id", F.col("id") + 1), layout, key, path)
    got = {r.supplier_id: (r.history_order_num, r.avg_a1_time, r.create_time, r.update_time) for r in table.collect()}
    assert got == {1: (5.0, 1.0, "t1", "t1"), 2: (6.0, 1.5, "t1", "t2"), 3: (7.0, 3.0, "t1", "t1"), 4: (1.0, 0.0, "t2", "t2")}
    assert {r.supplier_id: r.id for r in table.collect() if r.supplier_id < 4} == ids
    with pytest.raises(ValueError):
        sinks.publish_merged(run.union(run), layout, key, path)
    assert rows_of(daily.read_days(spark, path, by="version").select(*layout)) == rows_of(table)


def test_publication_of_runs_without_rows(spark, tmp_path):
    path, layout, key = str(tmp_path / "p"), schemas.SUPPLIER_HISTORY, schemas.SUPPLIER_HISTORY_KEY
    rows = published(spark, [(1, 1, 5, 1.0, 2.0)], "t1")
    for _ in range(2):
        table = sinks.publish_merged(rows.limit(0), layout, key, path)
        assert table.columns == [*layout] and table.collect() == []
    assert [r.supplier_id for r in sinks.publish_merged(rows, layout, key, path).collect()] == [1]


@pytest.fixture
def sample(tmp_path):
    folder = tmp_path / "sample"
    folder.mkdir()
    files = {
        "a.txt": [f"a{k}\t{k}" for k in range(900)],
        "b.txt": [f"b{k}\t{k}" for k in range(700)],
        "c.txt": [],
        "d.txt": ["", "d1\t1"],
        "e.txt": ["e0\t0"],
    }
    files["b.txt"][650] = " \t "
    files["b.txt"][660] = ""
    for name, lines in files.items():
        (folder / name).write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    kept = files["a.txt"] + files["b.txt"][:650] + files["e.txt"]
    return str(folder), files, kept


@pytest.mark.parametrize("limit", [-1, 0, 1, 899, 900, 901, 1549, 1550, 1551, 5000])
def test_first_lines(spark, sample, limit):
    path, _, kept = sample
    with small_splits(spark, "1000"):
        got = delimited.first_lines(spark, path, limit)
    wanted = kept if limit == -1 else kept[:limit]
    assert sorted(r.value for r in got.collect()) == sorted(wanted)
    assert all(r.value == f"{r.value[0]}{r.line - 1}\t{r.line - 1}" for r in got.collect())
    assert all(r.file.endswith(f"{r.value[0]}.txt") for r in got.collect())


def test_a_blank_line_in_a_later_split(spark, sample):
    path, files, _ = sample
    with small_splits(spark, "1000"):
        splits = spark.read.text(f"{path}/b.txt").rdd.getNumPartitions()
        got = delimited.read_samples(spark, f"{path}/b.txt", ["name", "k"])
        whole = delimited.read_samples(spark, f"{path}/b.txt", ["name", "k"], until_blank=False)
        part = delimited.read_samples(spark, f"{path}/b.txt", ["name", "k"], limit=655, until_blank=False)
    assert splits > 2
    assert sorted(int(r.k) for r in got.collect()) == list(range(650))
    assert whole.count() == 698
    assert sorted(int(r.k) for r in part.collect()) == [k for k in range(655) if k != 650]


def test_short_splits_share_tasks(spark, sample, monkeypatch):
    path, files, kept = sample
    tasks = []
    monkeypatch.setattr(delimited, "staged", lambda df, name: tasks.append(df.rdd.getNumPartitions()) or staged(df, name))
    with small_splits(spark, "100"):
        splits = spark.read.text(path).rdd.getNumPartitions()
        got = delimited.first_lines(spark, path)
    most = delimited.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert splits > 100 and tasks == [most]
    rows = got.collect()
    assert sorted(r.value for r in rows) == sorted(kept)
    assert all(r.value == f"{r.value[0]}{r.line - 1}\t{r.line - 1}" for r in rows)
