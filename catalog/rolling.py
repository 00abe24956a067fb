"""Libraries kept by day, tables that several runs write, and sample files read in line order."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from catalog.registry import query
from doorclock import fixtures as fx
from doorclock import schemas
from doorclock import settings as S
from doorclock.operators import history, moments
from doorclock.plans import phase_a, rolling
from doorclock.plans.staging import stage_folder
from doorclock.sources import daily, sinks
from doorclock.sources.delimited import first_lines, read_samples

Z, D = fx.ZONE, fx.DATES
# Derived orders without a fetch time match positions of any earlier day, and some positions are filed days late.
REACH = {"days_before": 31, "days_after": 6}


def _folder(spark, name):
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _windows(dates):
    values = ", ".join(f"('{d.first}', '{d.last}')" for d in dates)
    return f"(values {values}) as windows(window_first, window_end)"


_HISTORY_WINDOWS = [S.DateRange("2024-01-03", "2024-01-12"), S.DateRange("2024-01-11", "2024-01-20"), S.DateRange("2024-01-01", "2024-02-01")]
_HISTORY_ROWS = """arrive_time_unix > 1556621020 and fetch_time_unix > 1556621020
      and delivery_source_from <> 'jdMall' and distance > 0 and delivery_status = 4 and supplier_type_id <> 5"""


def _history_windows(owner):
    return f"""select window_end, '{owner}' as owner, {owner} as owner_id, city_id, count(*) as history_order_num,
      avg(a1_time) as avg_a1_time, avg(a2_time) as avg_a2_time
    from delivery_rows join {_windows(_HISTORY_WINDOWS)} on create_dt between window_first and window_end
    where {_HISTORY_ROWS} group by all"""


@query("history_rolling", " union all ".join(_history_windows(o) for o in rolling.OWNERS), {"avg_a1_time": 6, "avg_a2_time": 6})
def history_rolling(spark, sf):
    """Three windows of a library that grows by runs of many days, of one day, and of a day once more."""
    wh, folder = fx.warehouse(spark, sf), _folder(spark, "history")
    tables = {}
    runs = [S.DateRange("2024-01-01", "2024-01-19"), S.DateRange("2024-01-20", "2024-01-20"), S.DateRange("2024-01-21", "2024-02-01")]
    for window, run in zip(_HISTORY_WINDOWS, runs, strict=True):
        rolling.add_deliveries(wh, folder, run, Z)
        rolling.add_deliveries(wh, folder, S.DateRange("2024-01-05", "2024-01-05"), Z)
        parts = [
            rolling.history_over(spark, folder, window, o).withColumns({"owner": F.lit(o), "owner_id": F.col(o)}).drop(o)
            for o in rolling.OWNERS
        ]
        tables[window.last] = parts[0].unionByName(parts[1])
    return rolling.labelled(tables)


_STAY_WINDOWS = [S.DateRange("2024-01-05", "2024-01-14"), S.DateRange("2024-01-10", "2024-02-01")]


def _stays_by_day(spark, sf):
    wh, folder = fx.warehouse(spark, sf), _folder(spark, "stays")
    for run in (S.DateRange("2024-01-05", "2024-02-01"), S.DateRange("2024-01-12", "2024-01-12")):
        rolling.add_stays(wh, folder, run, Z, **REACH)
    return folder


@query(
    "peak_rolling",
    f"""select window_end, transporter_id, city_id, count(*) as delivery_cnt,
      cast(floor(avg(delivery_time2)) as int) as avg_delivery_time2,
      quantile_cont(delivery_time2, 0.5) as per_delivery_time2,
      count(*) filter (peek_time = 1) as cnt_peek1, count(*) filter (peek_time = 2) as cnt_peek2,
      count(*) filter (peek_time = 3) as cnt_peek3, count(*) filter (peek_time = 0) as cnt_peek0,
      quantile_cont(delivery_time2, 0.5) filter (peek_time = 1) as per_delivery_time_peek1,
      quantile_cont(delivery_time2, 0.5) filter (peek_time = 2) as per_delivery_time_peek2,
      quantile_cont(delivery_time2, 0.5) filter (peek_time = 3) as per_delivery_time_peek3,
      quantile_cont(delivery_time2, 0.5) filter (peek_time = 0) as per_delivery_time_peek0
    from c4_classes join (select order_id, create_dt from d_orders) using (order_id)
      join {_windows(_STAY_WINDOWS)} on create_dt between window_first and window_end
    group by window_end, transporter_id, city_id""",
)
def peak_rolling(spark, sf):
    folder = _stays_by_day(spark, sf)
    rules = S.DwellRules(peak_median=True)
    return rolling.labelled({w.last: rolling.courier_peak_over(spark, folder, w, rules) for w in _STAY_WINDOWS})


@query(
    "statistics_rolling",
    f"""select window_end, poi_id, city_id, poi_lat, poi_lng,
      quantile_cont(cast(delivery_time2 as int), 0.5) as percentile_delivery_time_poi,
      round(avg(delivery_time2), 1) as avg_delivery_time_poi,
      quantile_cont(cast(floor(distance) as int), 0.5) as percentile_distance_poi,
      stddev_pop(distance) as std_distance_poi, stddev_pop(delivery_time2) as std_delivery_time_poi,
      count(order_id) as order_cnt
    from c6 join (select order_id, create_dt from d_orders) using (order_id)
      join {_windows(_STAY_WINDOWS)} on create_dt between window_first and window_end
    group by window_end, poi_id, city_id, poi_lat, poi_lng having count(order_id) >= 5""",
    {"poi_lat": 6, "poi_lng": 6, "std_distance_poi": 6, "std_delivery_time_poi": 6},
)
def statistics_rolling(spark, sf):
    folder = _stays_by_day(spark, sf)
    return rolling.labelled({w.last: rolling.landmark_statistics_over(spark, folder, w) for w in _STAY_WINDOWS})


@query(
    "offset_deviation",
    """select supplier_id, count(*) as n, avg(1e8 + event_id % 7) as mean, stddev_pop(1e8 + event_id % 7) as deviation
    from trips group by supplier_id""",
    {"mean": 3, "deviation": 6},
)
def offset_deviation(spark, sf):
    """Small deviations of large values, merged from values to days and from days to the whole."""
    trips = fx.trips(spark, sf).select(
        "supplier_id", F.floor(F.col("accept_u") / fx.DAY_S).alias("day"), (F.lit(1e8) + F.col("event_id") % 7).alias("mean")
    )
    values = trips.groupBy("supplier_id", "day", "mean").agg(F.count(F.lit(1)).alias("n")).withColumn("m2", F.lit(0.0))
    days = moments.merged_parts(values, ["supplier_id", "day"])
    whole = moments.merged_parts(days, ["supplier_id"])
    return whole.select("supplier_id", "n", "mean", moments.deviation(F.col("n"), F.col("m2")).alias("deviation"))


@query(
    "daily_runs_read_back",
    """select delivery_id, transporter_id, city_id, create_dt as day from d_deliveries
    where create_dt between '2024-01-09' and '2024-01-11' and (create_dt <> '2024-01-10' or transporter_id % 2 = 0)""",
)
def daily_runs_read_back(spark, sf):
    """A run of two days, a run of a third, and the second of the first two once more, with other rows."""
    path = _folder(spark, "daily")
    rows = fx.warehouse(spark, sf).deliveries.select("delivery_id", "transporter_id", "city_id", F.col("create_dt").alias("day"))
    for days, kept in (
        (["2024-01-09", "2024-01-10"], F.lit(True)), (["2024-01-11"], F.lit(True)), (["2024-01-10"], F.col("transporter_id") % 2 == 0)
    ):
        daily.replace_days(rows.where(F.col("day").isin(days) & kept), path, days)
    return daily.read_days(spark, path, S.DateRange("2024-01-09", "2024-01-31"))


_RUNS = [
    (S.DateRange("2024-01-01", "2024-01-15"), "2024-01-16 00:00:00"),
    (S.DateRange("2024-01-10", "2024-02-01"), "2024-02-02 00:00:00"),
]


def _single_city_run(k):
    dates, time = _RUNS[k]
    return f"""select supplier_id, cast(any_value(n) as double) as history_order_num, any_value(a1) as avg_a1_time, any_value(a2) as avg_a2_time,
      cast(any_value(city_id) as int) as city_id, '{time}' as run_time
    from (select supplier_id, city_id, count(*) as n, avg(a1_time) as a1, avg(a2_time) as a2 from delivery_rows
      where create_dt between '{dates.first}' and '{dates.last}' and {_HISTORY_ROWS} group by supplier_id, city_id)
    group by supplier_id having count(*) = 1"""


@query(
    "history_published_twice",
    f"""with old as ({_single_city_run(0)}), run as ({_single_city_run(1)}),
    merged as (select coalesce(old.supplier_id, run.supplier_id) as supplier_id, old, run, old.supplier_id is null as is_new,
        run.supplier_id is not null and (old.supplier_id is null or
        (old.history_order_num, old.avg_a1_time, old.avg_a2_time, old.city_id)
        is distinct from (run.history_order_num, run.avg_a1_time, run.avg_a2_time, run.city_id)) as taken
      from old full join run on old.supplier_id = run.supplier_id)
    select supplier_id, case when taken then run.history_order_num else old.history_order_num end as history_order_num,
      case when taken then run.avg_a1_time else old.avg_a1_time end as avg_a1_time,
      case when taken then run.avg_a2_time else old.avg_a2_time end as avg_a2_time,
      case when taken then run.city_id else old.city_id end as city_id,
      case when is_new then run.run_time else old.run_time end as create_time,
      case when taken then run.run_time else old.run_time end as update_time
    from merged""",
    {"avg_a1_time": 6, "avg_a2_time": 6},
)
def history_published_twice(spark, sf):
    """Two runs over overlapping ranges, merged into the published table by its key."""
    wh, path = fx.warehouse(spark, sf), _folder(spark, "published")
    for dates, time in _RUNS:
        rows = history.published_history(phase_a.history_library(wh, dates, "supplier_id", Z), "supplier_id", time)
        table = sinks.publish_merged(rows, schemas.SUPPLIER_HISTORY, schemas.SUPPLIER_HISTORY_KEY, path)
    return table.drop("id")


@contextmanager
def small_splits(spark, size="4096"):
    """Files are read in many splits meanwhile, as large ones are."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


# One file per day, its lines by order; some lines are blank.
_IS_BLANK = "order_id % 211 = 5"
_SAMPLE_LINES = f"""select *, min(case when {_IS_BLANK} then order_id end) over (partition by create_dt) as stop,
      row_number() over (partition by create_dt order by order_id) as line from d_orders"""


def _sample_files(spark, sf):
    path = _folder(spark, "sample")
    line = F.when(F.expr(_IS_BLANK), " \t").otherwise(F.concat_ws("\t", F.col("order_id").cast("string"), "finish_time", "receiver_address"))
    rows = fx.warehouse(spark, sf).orders.select("create_dt", "order_id", line.alias("value"))
    ordered = rows.repartition("create_dt").sortWithinPartitions("create_dt", "order_id").drop("order_id")
    ordered.write.partitionBy("create_dt").text(path)
    return path


@query(
    "sample_until_blank",
    f"select cast(order_id as varchar) as order_id, finish_time, receiver_address, line from ({_SAMPLE_LINES}) where stop is null or order_id < stop",
)
def sample_until_blank(spark, sf):
    """Lines of each file up to its first blank one, with their numbers; files have several splits."""
    path = _sample_files(spark, sf)
    with small_splits(spark):
        lines = first_lines(spark, path)
    fields = F.split("value", "\t")
    names = ["order_id", "finish_time", "receiver_address"]
    return lines.select(*[F.get(fields, k).alias(name) for k, name in enumerate(names)], "line")


@query(
    "sample_first_lines",
    f"""select cast(order_id as varchar) as order_id, finish_time from ({_SAMPLE_LINES}) where stop is null or order_id < stop
    order by create_dt, order_id limit 700""",
)
def sample_first_lines(spark, sf):
    """The first 700 lines of a sample of several files, in file and line order."""
    path = _sample_files(spark, sf)
    with small_splits(spark):
        return read_samples(spark, path, ["order_id", "finish_time"], limit=700)
