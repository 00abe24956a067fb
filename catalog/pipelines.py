"""Joins, aggregations and windows of the two phases and the online check."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from doorclock import fixtures as fx
from doorclock import settings as S
from doorclock.operators import audit, errors, first_ping, geofence, history, peak, poi
from doorclock.plans import ab_check, audited, phase_a, phase_c
from doorclock.plans.staging import stage_folder, staged
from doorclock.sources import sinks, tables
from doorclock.sources.delimited import read_evaluation, read_samples
from doorclock import schemas

Z, D = fx.ZONE, fx.DATES
COORDS = {"r_lng": 6, "r_lat": 6}
STAY = {**COORDS, "s_r_line_distance": 3}
SHOP = {"supp_lat": 6, "supp_lng": 6}
FIRST_PING = {**SHOP, "lat": 6, "lng": 6, "real_time_line_distance": 3}
LANDMARK = {"poi_lat": 6, "poi_lng": 6}
STATISTICS = {"std_distance_poi": 6, "std_delivery_time_poi": 6}
MEANS = {"avg_a1_time": 6, "avg_a2_time": 6}
T_MEANS = {"t_avg_a1_time": 6, "t_avg_a2_time": 6}
S_MEANS = {"s_avg_a1_time": 6, "s_avg_a2_time": 6}
LOOKUP = {**STAY, **LANDMARK, **STATISTICS}


def _ranked(spark, sf):
    found, orders = phase_c.in_circle(fx.warehouse(spark, sf), D, Z)
    return geofence.ranked_pings(geofence.with_orders(found, orders), Z)


# --- hand-over phase ---------------------------------------------------------------------------


@query(
    "c_geofence_pings",
    "select * from c1",
    {**STAY, "t_lat": 6, "t_lng": 6},
)
def c_geofence_pings(spark, sf):
    return _ranked(spark, sf)


@query("c_overdwell_orders", "select * from c2", {**STAY, "t_lat": 6, "t_lng": 6})
def c_overdwell_orders(spark, sf):
    return geofence.overdwell_orders(_ranked(spark, sf))


@query("c_valid_pings", "select * from c3", {**STAY, "t_lat": 6, "t_lng": 6})
def c_valid_pings(spark, sf):
    return geofence.without_overdwell(_ranked(spark, sf))


@query("c_dwell", "select * from c4", STAY)
def c_dwell(spark, sf):
    return phase_c.dwell(fx.warehouse(spark, sf), D, Z)


@query("courier_peak", "select * from c5")
def courier_peak(spark, sf):
    return peak.courier_peak(phase_c.dwell(fx.warehouse(spark, sf), D, Z))


@query(
    "courier_peak_median",
    """select transporter_id, city_id, count(*) as delivery_cnt,
      cast(floor(avg(delivery_time2)) as int) as avg_delivery_time2,
      quantile_cont(delivery_time2, 0.5) as per_delivery_time2,
      count(*) filter (peek_time = 1) as cnt_peek1, count(*) filter (peek_time = 2) as cnt_peek2,
      count(*) filter (peek_time = 3) as cnt_peek3, count(*) filter (peek_time = 0) as cnt_peek0,
      quantile_cont(delivery_time2, 0.5) filter (peek_time = 1) as per_delivery_time_peek1,
      quantile_cont(delivery_time2, 0.5) filter (peek_time = 2) as per_delivery_time_peek2,
      quantile_cont(delivery_time2, 0.5) filter (peek_time = 3) as per_delivery_time_peek3,
      quantile_cont(delivery_time2, 0.5) filter (peek_time = 0) as per_delivery_time_peek0
    from c4_classes group by transporter_id, city_id""",
)
def courier_peak_median(spark, sf):
    rules = S.DwellRules(peak_median=True)
    return peak.courier_peak(phase_c.dwell(fx.warehouse(spark, sf), D, Z), rules)


@query(
    "peak_conform",
    f"""select transporter_id, city_id, delivery_cnt, -1 as avg_delivery_time1, avg_delivery_time2,
      -1 as per_delivery_time1, per_delivery_time2, cnt_peek1, cnt_peek2, cnt_peek3, cnt_peek0,
      -1 as per_delivery_time1_peek1, -1 as per_delivery_time1_peek2, -1 as per_delivery_time1_peek3,
      -1 as per_delivery_time1_peek0, per_delivery_time_peek1, per_delivery_time_peek2, per_delivery_time_peek3,
      per_delivery_time_peek0, '{fx.RUN_TIME}' as create_time, '{fx.RUN_TIME}' as update_time from c5""",
)
def peak_conform(spark, sf):
    table = peak.courier_peak(phase_c.dwell(fx.warehouse(spark, sf), D, Z))
    # The id is a digest of the key, which the check cannot compute.
    return peak.published_peak(table, fx.RUN_TIME).drop("id")


@query(
    "peak_published_layout",
    f"""select transporter_id, cast(city_id as int) as city_id, cast(delivery_cnt as int) as delivery_cnt,
      -1 as avg_delivery_time1, avg_delivery_time2, -1 as per_delivery_time1,
      cast(trunc(per_delivery_time2) as int) as per_delivery_time2,
      cast(cnt_peek1 as int) as cnt_peek1, cast(cnt_peek2 as int) as cnt_peek2,
      cast(cnt_peek3 as int) as cnt_peek3, cast(cnt_peek0 as int) as cnt_peek0,
      -1 as per_delivery_time1_peek1, -1 as per_delivery_time1_peek2, -1 as per_delivery_time1_peek3,
      -1 as per_delivery_time1_peek0, coalesce(per_delivery_time_peek1, -1) as per_delivery_time_peek1,
      coalesce(per_delivery_time_peek2, -1) as per_delivery_time_peek2,
      coalesce(per_delivery_time_peek3, -1) as per_delivery_time_peek3,
      coalesce(per_delivery_time_peek0, -1) as per_delivery_time_peek0,
      '{fx.RUN_TIME}' as create_time, '{fx.RUN_TIME}' as update_time from c5""",
)
def peak_published_layout(spark, sf):
    table = peak.courier_peak(phase_c.dwell(fx.warehouse(spark, sf), D, Z))
    return schemas.conformed(peak.published_peak(table, fx.RUN_TIME), schemas.COURIER_PEAK).drop("id")


@query("c_poi_bind", "select * from c6", {**STAY, **LANDMARK})
def c_poi_bind(spark, sf):
    wh = fx.warehouse(spark, sf)
    return phase_c.bound(wh, phase_c.dwell(wh, D, Z))


@query("poi_statistics", "select * from c7", {**LANDMARK, **STATISTICS})
def poi_statistics(spark, sf):
    wh = fx.warehouse(spark, sf)
    return poi.poi_statistics(phase_c.bound(wh, phase_c.dwell(wh, D, Z)))


def _library(spark, sf):
    """Warehouse, stays, rows bound to landmarks (staged) and landmark statistics."""
    wh = fx.warehouse(spark, sf)
    stays = staged(phase_c.dwell(wh, D, Z), "dwell")
    bound = staged(phase_c.bound(wh, stays), "bound")
    return wh, stays, bound, poi.poi_statistics(bound)


def _looked_up(spark, sf):
    wh, _, bound, statistics = _library(spark, sf)
    return wh, poi.landmark_lookup(bound, statistics)


@query("c_poi_lookup", "select * from c8", LOOKUP)
def c_poi_lookup(spark, sf):
    return _looked_up(spark, sf)[1]


@query("c_courier_history", "select * from c9", {**LOOKUP, **T_MEANS})
def c_courier_history(spark, sf):
    wh, rows = _looked_up(spark, sf)
    return phase_c.with_courier_history(rows, phase_a.history_library(wh, D, "transporter_id", Z))


def handover_sample(spark, sf):
    wh, stays, bound, statistics = _library(spark, sf)
    couriers = phase_a.history_library(wh, D, "transporter_id", Z)
    return phase_c.sample(bound, statistics, couriers, peak.courier_peak(stays))


@query("c_sample", "select * from c10", {**LOOKUP, **T_MEANS})
def c_sample(spark, sf):
    return handover_sample(spark, sf)


@query("c_sample_first_generation", "select * from g10", {**LOOKUP, **T_MEANS})
def c_sample_first_generation(spark, sf):
    wh = fx.warehouse(spark, sf)
    stays = staged(phase_c.dwell(wh, D, Z, S.FIRST_GENERATION), "dwell-first-generation")
    couriers = phase_a.history_library(wh, D, "transporter_id", Z)
    return phase_c.first_generation_sample(wh, stays, couriers)


@query(
    "funnel_audit",
    """select 'c1_in_circle' as step, count(*) as n_rows, count(distinct order_id) as n_keys from c1
    union all select 'c2_overdwell', count(*), count(distinct order_id) from c2
    union all select 'c3_not_overdwell', count(*), count(distinct order_id) from c3
    union all select 'c4_dwell', count(*), count(distinct order_id) from c4
    union all select 'c5_courier_peak', count(*), count(distinct transporter_id) from c5
    union all select 'c6_bound', count(*), count(distinct order_id) from c6
    union all select 'c7_statistics', count(*), count(distinct poi_id) from c7
    union all select 'a1_accepted', count(*), count(distinct delivery_id) from a1
    union all select 'supplier_history', count(*), count(distinct supplier_id) from supplier_hist
    union all select 'supplier_single_city', count(*), count(distinct supplier_id) from supplier_single
    union all select 'courier_history', count(*), count(distinct transporter_id) from courier_hist
    union all select 'courier_single_city', count(*), count(distinct transporter_id) from courier_single""",
)
def funnel_audit(spark, sf):
    """Counts of every step, observed while the libraries are written."""
    return audited.libraries(fx.warehouse(spark, sf), D, Z).funnel


@query(
    "time_coverage",
    "select min(finish_time) as min_finish_time, max(finish_time) as max_finish_time from c4",
)
def time_coverage(spark, sf):
    return audit.time_coverage(phase_c.dwell(fx.warehouse(spark, sf), D, Z))


# --- pick-up phase -----------------------------------------------------------------------------


@query("a_supplier_enrich", "select * from a_enriched", SHOP)
def a_supplier_enrich(spark, sf):
    return phase_a.enriched_deliveries(fx.warehouse(spark, sf), D, Z)


@query("a_first_ping", "select * from a1", FIRST_PING)
def a_first_ping(spark, sf):
    return phase_a.accepted_positions(fx.warehouse(spark, sf), D, Z)


@query("a_min_distance", "select * from a1 where real_time_line_distance >= 300", FIRST_PING)
def a_min_distance(spark, sf):
    rules = S.PickupRules(min_distance_m=300.0)
    first = phase_a.accepted_positions(fx.warehouse(spark, sf), D, Z, rules)
    return first_ping.far_enough(first, rules)


def _history(spark, sf, owner):
    base = tables.delivery_history_base(fx.warehouse(spark, sf).deliveries, D, Z)
    return history.delivery_history(base, owner)


@query("supplier_history", "select * from supplier_hist", MEANS)
def supplier_history(spark, sf):
    return _history(spark, sf, "supplier_id")


@query("courier_history", "select * from courier_hist", MEANS)
def courier_history(spark, sf):
    return _history(spark, sf, "transporter_id")


@query("supplier_history_single_city", "select * from supplier_single", MEANS)
def supplier_history_single_city(spark, sf):
    return history.single_city(_history(spark, sf, "supplier_id"), "supplier_id")


@query("courier_history_single_city", "select * from courier_single", MEANS)
def courier_history_single_city(spark, sf):
    return history.single_city(_history(spark, sf, "transporter_id"), "transporter_id")


@query(
    "supplier_multi_city",
    "select supplier_id, count(*) as n_cities from supplier_hist group by supplier_id having count(*) > 1",
)
def supplier_multi_city(spark, sf):
    return history.multi_city_owners(_history(spark, sf, "supplier_id"), "supplier_id")


@query(
    "courier_multi_city",
    "select transporter_id, count(*) as n_cities from courier_hist group by transporter_id having count(*) > 1",
)
def courier_multi_city(spark, sf):
    return history.multi_city_owners(_history(spark, sf, "transporter_id"), "transporter_id")


@query(
    "supplier_history_published",
    f"""select supplier_id, cast(history_order_num as double) as history_order_num, avg_a1_time, avg_a2_time,
      cast(city_id as int) as city_id, '{fx.RUN_TIME}' as create_time, '{fx.RUN_TIME}' as update_time
    from supplier_single""",
    MEANS,
)
def supplier_history_published(spark, sf):
    rows = history.single_city(_history(spark, sf, "supplier_id"), "supplier_id")
    published = history.published_history(rows, "supplier_id", fx.RUN_TIME)
    return schemas.conformed(published, schemas.SUPPLIER_HISTORY).drop("id")


@query(
    "courier_history_published",
    f"""select transporter_id, cast(history_order_num as double) as history_order_num, avg_a1_time, avg_a2_time,
      cast(city_id as int) as city_id, '{fx.RUN_TIME}' as create_time, '{fx.RUN_TIME}' as update_time
    from courier_single""",
    MEANS,
)
def courier_history_published(spark, sf):
    rows = history.single_city(_history(spark, sf, "transporter_id"), "transporter_id")
    published = history.published_history(rows, "transporter_id", fx.RUN_TIME)
    return schemas.conformed(published, schemas.COURIER_HISTORY).drop("id")


@query(
    "poi_statistics_published",
    f"""select poi_id, percentile_delivery_time_poi, avg_delivery_time_poi, percentile_distance_poi, std_distance_poi,
      std_delivery_time_poi, cast(order_cnt as int) as order_cnt, cast(city_id as int) as city_id, poi_lat, poi_lng,
      '{fx.RUN_TIME}' as create_time, '{fx.RUN_TIME}' as update_time from c7""",
    {**LANDMARK, **STATISTICS},
)
def poi_statistics_published(spark, sf):
    wh = fx.warehouse(spark, sf)
    rows = poi.poi_statistics(phase_c.bound(wh, phase_c.dwell(wh, D, Z)))
    return schemas.conformed(poi.published_statistics(rows, fx.RUN_TIME), schemas.POI_STATISTICS).drop("id")


def _exported(rows, write):
    """A folder of the shared stage that holds rows as a sink writes them."""
    path = f"{stage_folder(rows.sparkSession)}/export-{uuid.uuid4().hex}"
    write(rows, path)
    return path


@query(
    "tsv_export_read_back",
    """select cast(order_id as varchar) as order_id, fetch_time, finish_time, receiver_address,
      case when order_id % 5 = 0 then '-1' else cast(cargo_type_id as varchar) end as cargo_type_id from d_orders""",
)
def tsv_export_read_back(spark, sf):
    """The text export of orders, some fields null, read again as a sample."""
    columns = ["order_id", "fetch_time", "finish_time", "receiver_address"]
    kind = F.when(F.col("order_id") % 5 != 0, F.col("cargo_type_id")).alias("cargo_type_id")
    path = _exported(fx.warehouse(spark, sf).orders.select(*columns, kind), sinks.export_tsv)
    return read_samples(spark, path, [*columns, "cargo_type_id"])


@query(
    "evaluation_csv_read_back",
    """select cast(isdowngrade as int) as isdowngrade, test_id, cast(pickuptimevalue as double) as pickuptimevalue,
      cast(a2_time as double) as a2_time from ab_a""",
)
def evaluation_csv_read_back(spark, sf):
    pairs = ab_check.pickup_pairs(fx.warehouse(spark, sf), D, D, Z)
    columns = ["a2_time", "pickuptimevalue", "test_id", "isdowngrade", "orderid"]
    path = _exported(pairs.select(*columns), sinks.export_csv)
    return read_evaluation(spark, path, "pickuptimevalue", "a2_time")


@query("table_read_back", "select * from supplier_hist", MEANS)
def table_read_back(spark, sf):
    rows = _history(spark, sf, "supplier_id")
    return sinks.read_table(spark, _exported(rows, sinks.replace_table))


@query(
    "history_duplicate_keys",
    "select supplier_id, count(*) as n_rows from supplier_hist group by supplier_id having count(*) > 1",
)
def history_duplicate_keys(spark, sf):
    return sinks.duplicate_keys(_history(spark, sf, "supplier_id"), ["supplier_id"])


def pickup_sample(spark, sf):
    wh = fx.warehouse(spark, sf)
    return phase_a.sample(
        wh,
        D,
        phase_a.history_library(wh, D, "transporter_id", Z),
        phase_a.history_library(wh, D, "supplier_id", Z),
        Z,
    )


@query("a_sample", "select * from a3", {**FIRST_PING, **T_MEANS, **S_MEANS})
def a_sample(spark, sf):
    return pickup_sample(spark, sf)


# --- online check ------------------------------------------------------------------------------


@query("ab_join_a", "select * from ab_a", {"real_time_line_distance": 3})
def ab_join_a(spark, sf):
    return ab_check.pickup_pairs(fx.warehouse(spark, sf), D, D, Z)


@query("ab_join_c", "select * from ab_c")
def ab_join_c(spark, sf):
    return ab_check.receiver_pairs(fx.warehouse(spark, sf), D, D, Z)


DAY = "2024-01-10"
_DAYS = ("create_dt >= '2024-01-09' and create_dt <= '2024-01-10'", "dt = '2024-01-10'")


@query(
    "ab_join_a_day",
    f"""select ab_a.* from ab_a where cast(orderid as bigint) in (
      select cast(json_extract_string(data, '$.orderId') as bigint) from d_log where biz_type = 10604 and {_DAYS[1]})
      and cast(orderid as bigint) in (select delivery_id from d_deliveries where {_DAYS[0]})""",
    {"real_time_line_distance": 3},
)
def ab_join_a_day(spark, sf):
    """The job of one day: that day's log, the orders of it and of the day before."""
    days = ab_check.previous_and(DAY)
    return ab_check.pickup_pairs(fx.warehouse(spark, sf), S.DateRange(DAY, DAY), days, Z)


@query(
    "ab_join_c_day",
    f"""with found as (
      select * from m1 where log_dt >= '2024-01-09' and log_dt <= '2024-01-10' and order_day >= '2024-01-09' and order_day <= '2024-01-10'),
    stay as (
      select order_id, any_value(transporter_id) as transporter_id, any_value(finish_time_unix) as finished,
        any_value(receiver_address) as receiver_address, any_value(cargo_type_id) as cargo_type_id,
        any_value(cargo_weight) as cargo_weight, min(report_unixtime) as entered, max(report_unixtime) as left_at, count(*) as point_cnt
      from found group by order_id)
    select receivertimevalue, recorderid, orderid, isdowngrade, test_id, cityid, transporterid, now_timestamp,
      left_at - entered as delivery_time2, finished - entered as delivery_time1, receiver_address, cargo_type_id, cargo_weight
    from log_values join stay on cast(orderid as bigint) = order_id and cast(transporterid as bigint) = transporter_id
    where biz_type = 10610 and dt = '2024-01-10' and finished - entered <= 800 and point_cnt > 1 and finished > entered and left_at > finished""",
)
def ab_join_c_day(spark, sf):
    days = ab_check.previous_and(DAY)
    return ab_check.receiver_pairs(fx.warehouse(spark, sf), S.DateRange(DAY, DAY), days, Z)


_REPORT = """select segment, count(*) as n, cast(floor(avg(err)) as bigint) as mean_error_s,
      round(avg(rel) * 100, 1) as mape_pct,
      round(avg(case when rel > 0.3e0 then 1e0 when rel is not null then 0e0 end) * 100, 1) as over30_pct,
      round(avg(case when rel > 0.5e0 then 1e0 when rel is not null then 0e0 end) * 100, 1) as over50_pct,
      round(avg(case when rel > 0.7e0 then 1e0 when rel is not null then 0e0 end) * 100, 1) as over70_pct,
      count(*) filter (measured = 0) as n_zero_truth, any_value(n_missing) as n_missing,
      round(quantile_cont(err, 0.5), 1) as p50, round(quantile_cont(err, 0.67), 1) as p67,
      round(quantile_cont(err, 0.8), 1) as p80, round(quantile_cont(err, 0.95), 1) as p95
    from (select segment, measured, cast(abs(predicted - measured) as double) as err,
      abs(predicted - measured) / nullif(cast(measured as double), 0) as rel, n_missing
      from (select *, count(*) filter (predicted is null or measured is null) over (partition by segment) as n_missing from ({rows}))
      where predicted is not null and measured is not null)
    group by segment"""

_AB_ROWS = """select 'isdowngrade=' || isdowngrade as segment, {p} as predicted, {m} as measured from {t}
      union all select 'test_id=' || test_id, {p}, {m} from {t} where test_id in ('blank', 'new')"""


@query("ab_error_report", _REPORT.format(rows=_AB_ROWS.format(t="ab_a", p="pickuptimevalue", m="a2_time")))
def ab_error_report(spark, sf):
    pairs = ab_check.pickup_pairs(fx.warehouse(spark, sf), D, D, Z)
    return ab_check.pickup_report(staged(pairs, "ab-pickup"))


@query(
    "ab_error_report_c",
    _REPORT.format(rows=_AB_ROWS.format(t="ab_c", p="receivertimevalue", m="delivery_time2")),
)
def ab_error_report_c(spark, sf):
    pairs = ab_check.receiver_pairs(fx.warehouse(spark, sf), D, D, Z)
    return ab_check.receiver_report(staged(pairs, "ab-receiver"))


@query(
    "error_report",
    _REPORT.format(
        rows="select 'all' as segment, percentile_delivery_time_poi as predicted, delivery_time2 as measured from c8"
    ),
)
def error_report(spark, sf):
    pair = ["percentile_delivery_time_poi", "delivery_time2"]
    rows = staged(_looked_up(spark, sf)[1].select(*pair), "estimates")  # a report reads it twice
    return errors.error_report(rows, *map(F.col, pair))


@query(
    "median_value",
    """select 'all' as segment, quantile_cont(a2_time, 0.5) as p50 from delivery_scan""",
)
def median_value(spark, sf):
    rows = tables.delivery_scan(fx.warehouse(spark, sf).deliveries, D, Z)
    return errors.exact_percentiles(rows, F.col("a2_time"), (0.5,))
