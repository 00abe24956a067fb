"""Scans, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from doorclock import fixtures as fx
from doorclock import settings as S
from doorclock.functions import geo, scaling, text, times
from doorclock.operators import peak, sampling
from doorclock.operators.history import delivery_history
from doorclock.operators.prefix import dense_ids
from doorclock.schemas import RATING_SAMPLE
from doorclock.sources import tables
from doorclock.sources.delimited import parse_lines

Z, D = fx.ZONE, fx.DATES


@query("order_scan", "select * from order_scan", {"s_r_line_distance": 3})
def order_scan(spark, sf):
    return tables.order_scan(fx.warehouse(spark, sf).orders, D, Z)


@query("delivery_scan", "select * from delivery_scan")
def delivery_scan(spark, sf):
    return tables.delivery_scan(fx.warehouse(spark, sf).deliveries, D, Z)


@query("delivery_history_base", "select * from history_base")
def delivery_history_base(spark, sf):
    return tables.delivery_history_base(fx.warehouse(spark, sf).deliveries, D, Z)


@query(
    "ping_scan",
    """select user_id, lat, lng, logging_unixtime as log_time
    from coords where log_dt >= '2024-01-01' and log_dt <= '2024-02-01' and lat > 0 and lng > 0""",
)
def ping_scan(spark, sf):
    return tables.ping_scan(fx.warehouse(spark, sf).coords, D, positive_only=True)


@query(
    "supplier_scan",
    """select supplier_id, supplier_lat, supplier_lng, supplier_type_id from d_suppliers
    where supplier_type_id <> 5 and supplier_lat > 0 and supplier_lng > 0""",
    {"supplier_lat": 6, "supplier_lng": 6},
)
def supplier_scan(spark, sf):
    return tables.supplier_scan(fx.warehouse(spark, sf).suppliers)


@query(
    "poi_scan",
    """select lng, lat, poi_name, poi_id, distance, poi_lat, poi_lng from d_poi_info
    where poi_name is not null and poi_type = 'landmark_l2'""",
    {"lng": 6, "lat": 6, "poi_lat": 6, "poi_lng": 6},
)
def poi_scan(spark, sf):
    return tables.poi_scan(fx.warehouse(spark, sf).poi_info)


@query(
    "log_scan",
    """select dt, biz_type, data from d_log where dt >= '2024-01-01' and dt <= '2024-02-01' and biz_type = 10604""",
)
def log_scan(spark, sf):
    log = fx.warehouse(spark, sf).biz_log
    return tables.log_scan(log, D, S.LOG_TYPE_PICKUP).select("dt", "biz_type", "data")


@query(
    "phase_durations",
    "select delivery_id, a_time, a1_time, a2_time, finish_time_unix - fetch_time_unix as bc_time from delivery_rows",
)
def phase_durations(spark, sf):
    return tables.with_phase_durations(fx.warehouse(spark, sf).deliveries, Z).select(
        "delivery_id",
        "a_time",
        "a1_time",
        "a2_time",
        (F.col("finish_time_unix") - F.col("fetch_time_unix")).alias("bc_time"),
    )


@query(
    "peak_class",
    """select delivery_id, cast(h as int) as finish_hour, peek_time
    from d_deliveries join hour_classes on hour(finish_time::timestamp) = h""",
)
def peak_class(spark, sf):
    return peak.with_peak_class(fx.warehouse(spark, sf).deliveries).select(
        "delivery_id", "finish_hour", "peek_time"
    )


@query(
    "time_features",
    """select delivery_id, cast(hour(t) as int) as hour, cast(isodow(t) - 1 as int) as weekday,
      case when isodow(t) in (6, 7) then 1 else 0 end as is_weekend
    from (select delivery_id, finish_time::timestamp as t from d_deliveries)""",
)
def time_features(spark, sf):
    finish = F.col("finish_time")
    weekday = times.weekday_of(finish)
    return fx.warehouse(spark, sf).deliveries.select(
        "delivery_id",
        times.hour_of(finish).alias("hour"),
        weekday.alias("weekday"),
        F.when(weekday > 4, 1).otherwise(0).alias("is_weekend"),
    )


@query(
    "date_offset",
    """select delivery_id, strftime(d - interval 1 day, '%Y-%m-%d') as day_before,
      strftime(d - to_days(cast(n as int)), '%Y%m%d') as compact
    from (select delivery_id, create_dt::date as d, delivery_id % 40 as n from d_deliveries)""",
)
def date_offset(spark, sf):
    day = F.col("create_dt")
    return fx.warehouse(spark, sf).deliveries.select(
        "delivery_id",
        times.days_before(day, 1).alias("day_before"),
        times.compact_date(day, (F.col("delivery_id") % 40).cast("int")).alias("compact"),
    )


@query(
    "unix_time_text",
    """select delivery_id, unix_of(arrive_time) as arrive_u,
      strftime(make_timestamp((unix_of(fetch_time) + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') as fetch_in_shanghai,
      unix_of(fetch_time) - 28800 as fetch_read_as_shanghai
    from d_deliveries""",
)
def unix_time_text(spark, sf):
    fetch = F.col("fetch_time")
    return fx.warehouse(spark, sf).deliveries.select(
        "delivery_id",
        times.parse_epoch(F.col("arrive_time"), Z).alias("arrive_u"),
        times.format_epoch(times.parse_epoch(fetch, Z), S.WAREHOUSE_ZONE).alias("fetch_in_shanghai"),
        times.parse_epoch(fetch, S.WAREHOUSE_ZONE).alias("fetch_read_as_shanghai"),
    )


@query(
    "geo_distance",
    """select order_id, haversine_m(receiver_lng, receiver_lat, supplier_lng, supplier_lat) as metres
    from d_orders""",
    {"metres": 3},
)
def geo_distance(spark, sf):
    return fx.warehouse(spark, sf).orders.select(
        "order_id",
        geo.distance_m(
            F.col("receiver_lng"), F.col("receiver_lat"), F.col("supplier_lng"), F.col("supplier_lat")
        ).alias("metres"),
    )


@query(
    "geohash7",
    """select order_id, geohash7_of(supplier_lng, supplier_lat) as s_geohash,
      geohash7_of(receiver_lng, receiver_lat) as r_geohash from d_orders""",
)
def geohash7(spark, sf):
    return fx.warehouse(spark, sf).orders.select(
        "order_id",
        geo.geohash7(F.col("supplier_lng"), F.col("supplier_lat")).alias("s_geohash"),
        geo.geohash7(F.col("receiver_lng"), F.col("receiver_lat")).alias("r_geohash"),
    )


@query(
    "point_key",
    """select order_id, cast(round(receiver_lng * 100000) as bigint) as x,
      cast(round(receiver_lat * 100000) as bigint) as y from d_orders""",
)
def point_key(spark, sf):
    return fx.warehouse(spark, sf).orders.select(
        "order_id",
        geo.point_key(F.col("receiver_lng")).alias("x"),
        geo.point_key(F.col("receiver_lat")).alias("y"),
    )


_LOG_FIELDS = """json_extract_string(data, '$.recOrderId') as recorderid,
      json_extract_string(data, '$.orderId') as orderid,
      json_extract_string(data, '$.isDowngrade') as isdowngrade,
      json_extract_string(data, '$.test_id') as test_id,
      json_extract_string(data, '$.cityId') as cityid,
      json_extract_string(data, '$.transporterId') as transporterid,
      json_extract_string(data, '$.now_timestamp') as now_timestamp"""


@query(
    "json_extract",
    f"""select {_LOG_FIELDS}, json_extract_string(data, '$.supplierLat') as supplierlat,
      try_cast(json_extract_string(data, '$.pickupTimeValue') as int) as pickuptimevalue
    from d_log where biz_type = 10604""",
)
def json_extract(spark, sf):
    log = fx.warehouse(spark, sf).biz_log
    return tables.pickup_log(tables.log_scan(log, D, S.LOG_TYPE_PICKUP))


@query(
    "json_nested",
    """select json_extract_string(data, '$.order_id') as order_id, json_extract_string(data, '$.prob') as prob,
      json_extract_string(data, '$.dynamic_info.time_window_key') as time_window_key,
      json_extract_string(data, '$.dynamic_info.overtime_allowance') as overtime_allowance,
      json_extract_string(data, '$.dynamic_info.tips') as tips,
      json_extract_string(data, '$.dynamic_info.allowance') as allowance
    from d_log where biz_type = 10564""",
)
def json_nested(spark, sf):
    log = fx.warehouse(spark, sf).biz_log
    return tables.probability_log(tables.log_scan(log, D, S.LOG_TYPE_PROBABILITY))


@query(
    "event_props",
    """select event_id, cast(json_extract_string(props, '$.k') as int) as k from events""",
)
def event_props(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", text.json_field(F.col("props"), "k").try_cast("int").alias("k")
    )


@query(
    "sample_parse",
    "select transporter_id, score, grade, work_dt_cnt, avg_dis, avg_speed, invalid_cnt, not_first_invalid, invalid_label from d_rating",
)
def sample_parse(spark, sf):
    return parse_lines(fx.rating_lines(fx.trips(spark, sf)), RATING_SAMPLE, mask_nulls=False)


@query(
    "sample_parse_masked",
    """select transporter_id, replace(score, 'NULL', '-1') as score, grade, work_dt_cnt, avg_dis, avg_speed,
      replace(invalid_cnt, 'None', '-1') as invalid_cnt, not_first_invalid, invalid_label from d_rating""",
)
def sample_parse_masked(spark, sf):
    return parse_lines(fx.rating_lines(fx.trips(spark, sf)), RATING_SAMPLE)


@query(
    "null_words",
    """select order_id, replace(replace(replace(line, 'NULL', '-1'), 'Null', '-1'), 'None', '-1') as line
    from (select event_id as order_id, case event_id % 4 when 0 then 'NULL' when 1 then 'Null' when 2 then 'None' else 'null' end
      || chr(9) || event_id || chr(9) || case when event_id % 5 = 0 then 'aNoneb' else 'x' end as line from trips)""",
)
def null_words(spark, sf):
    e = F.col("event_id")
    word = F.when(e % 4 == 0, "NULL").when(e % 4 == 1, "Null").when(e % 4 == 2, "None").otherwise("null")
    line = F.concat_ws("\t", word, e.cast("string"), F.when(e % 5 == 0, "aNoneb").otherwise("x"))
    return fx.trips(spark, sf).select(
        e.alias("order_id"), text.mask_null_words(line).alias("line")
    )


_CN_VALUE = """list_sum(list_transform(range(1, length(seg) + 1), lambda i:
        instr('一二三四五六七八九', substr(seg, i, 1))
        * case when substr(seg, i + 1, 1) = '十' then 10 else 1 end))
      + case when substr(seg, 1, 1) = '十' then 10 else 0 end"""

_PLAIN_ADDRESS = f"""select order_id, receiver_address, replace(replace(replace(list_aggregate(list_transform(
      regexp_extract_all(receiver_address, '[一二三四五六七八九十]+|[^一二三四五六七八九十]+'),
      lambda seg: case when regexp_matches(seg, '^[一二三四五六七八九十]') then cast({_CN_VALUE} as varchar) else seg end
    ), 'string_agg', ''), 'B', '-'), 'b', '-'), '负', '-') as plain from d_orders"""


@query(
    "address_floor",
    f"""select order_id, length(receiver_address) as n_chars, plain,
      cast(case when found is null then 0
        when length(bare) > 2 then cast(substr(bare, 1, length(bare) - 2) as bigint) else cast(bare as bigint) end as bigint) as floor
    from (select *, regexp_replace(found, '楼|室|层|房|[A-Za-z]| ', '', 'g') as bare
      from (select *, coalesce(regexp_extract_all(plain, '-[0-9]楼|-[0-9]层|-[0-9][fF]')[1],
        regexp_extract_all(plain, '[0-9]+楼|[0-9]{{3,4}}$|[0-9]{{3,4}} |[0-9]{{3,4}}室|[0-9]{{3,4}}房|[0-9]+层|[0-9]+[A-Za-z]')[1]) as found
      from ({_PLAIN_ADDRESS})))""",
)
def address_floor(spark, sf):
    address = F.col("receiver_address")
    return fx.warehouse(spark, sf).orders.select(
        "order_id",
        F.char_length(address).cast("long").alias("n_chars"),
        text.arabic_address(address).alias("plain"),
        text.address_floor(address).alias("floor"),
    )


@query(
    "address_building",
    f"""select order_id, coalesce(cast(regexp_replace(
      regexp_extract_all(plain, '[0-9]+号楼|[0-9]+栋|[0-9]+幢')[1], '号楼|栋|幢', '', 'g') as bigint), -999) as building
    from ({_PLAIN_ADDRESS})""",
)
def address_building(spark, sf):
    return fx.warehouse(spark, sf).orders.select(
        "order_id", text.address_building(F.col("receiver_address")).alias("building")
    )


@query(
    "label_transform",
    """select delivery_id, ln(1 + a_time) as target, cast(a_time as double) as back
    from delivery_rows""",
    {"target": 6, "back": 6},
)
def label_transform(spark, sf):
    rows = tables.with_phase_durations(fx.warehouse(spark, sf).deliveries, Z)
    target = scaling.compress(F.col("a_time"))
    return rows.select("delivery_id", target.alias("target"), scaling.expand(target).alias("back"))


@query(
    "minmax_fixed",
    """select event_id, least(1e0, (event_id * 17 % 2500) / 2000e0) as score,
      least(1e0, (event_id * 13 % 16000 + 300 - 500e0) / 14500e0) as avg_dis,
      least(1e0, (event_id % 8 * 0.5e0 - 0.5e0) / 3.5e0) as avg_speed,
      least(1e0, (event_id % 30) / 29e0) as work_dt_cnt
    from trips""",
    {"score": 6, "avg_dis": 6, "avg_speed": 6, "work_dt_cnt": 6},
)
def minmax_fixed(spark, sf):
    e = F.col("event_id")
    values = {
        "score": (e * 17) % 2500,
        "avg_dis": (e * 13) % 16000 + 300,
        "avg_speed": e % 8 * F.lit(0.5),
        "work_dt_cnt": e % 30 + 1,
    }
    return fx.trips(spark, sf).select(
        "event_id", *[scaling.scaled(n, v).alias(n) for n, v in values.items()]
    )


@query(
    "hash_split",
    """select order_id, case when cast('0x' || substr(md5(cast(order_id as varchar)), 1, 7) as bigint) % 100 < 80
      then 'train' else 'test' end as split from d_orders""",
)
def hash_split(spark, sf):
    return fx.warehouse(spark, sf).orders.select(
        "order_id", sampling.split_name(F.col("order_id")).alias("split")
    )


@query(
    "surrogate_id",
    """select row_number() over (order by substr(md5(supplier_id || '|' || city_id), 1, 3), supplier_id, city_id) as id,
      supplier_id, city_id, history_order_num from supplier_hist""",
)
def surrogate_id(spark, sf):
    base = tables.delivery_history_base(fx.warehouse(spark, sf).deliveries, D, Z)
    rows = delivery_history(base, "supplier_id").select("supplier_id", "city_id", "history_order_num")
    return dense_ids(rows, "supplier_id", "city_id").select("id", *rows.columns)


@query(
    "first_n_samples",
    "select order_id, finish_time from d_orders order by order_id limit 1000",
)
def first_n_samples(spark, sf):
    orders = fx.warehouse(spark, sf).orders
    return orders.select("order_id", "finish_time").orderBy("order_id").limit(1000)
