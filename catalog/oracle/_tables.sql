-- @table trips
select t5.*,
  30e0 + city_id * 0.1e0 + (event_id % 4) * 0.01e0 as s_lat,
  120e0 + city_id * 0.1e0 as s_lng,
  30e0 + city_id * 0.1e0 + poi_k * 0.01e0 + 0.005e0 as r_lat,
  120e0 + city_id * 0.1e0 + 0.008e0 as r_lng
from (
  select *, fetch_u + 120 + (event_id * 71) % 600 + case when event_id % 50 = 0 then 3000 else 0 end as finish_u
  from (
    select *, arrive_u + 30 + (event_id * 53) % 500 as fetch_u
    from (
      select event_id, value, user_id as transporter_id,
        case when event_id % 97 = 0 then (user_id + 1) % 25 else user_id % 25 end as city_id,
        (user_id % 25) + 25 * (event_id % 4) as supplier_id,
        case when event_id % 31 = 0 then 8 else event_id % 8 end as poi_k,
        cast(floor(epoch(ts)) as bigint) as accept_u,
        cast(floor(epoch(ts)) as bigint) + 60 + (event_id * 37) % 600 as arrive_u
      from events
    ) t3
  ) t4
) t5

-- @table coords
select transporter_id as user_id, log_time - case when (event_id + i) % 197 = 0 then 432000 else 0 end as logging_unixtime,
  strftime(make_timestamp(log_time * 1000000), '%Y-%m-%d') as log_dt,
  case when lost then 0e0
    when log_time < arrive_u then s_lat + 0.004e0 * (arrive_u - accept_u - 30 * i) / (arrive_u - accept_u)
    when log_time < fetch_u then s_lat
    else s_lat + (r_lat - s_lat) * least(1e0, (log_time - fetch_u) / (0.6e0 * (finish_u - fetch_u))) end as lat,
  case when lost then 0e0
    when log_time < fetch_u then s_lng
    else s_lng + (r_lng - s_lng) * least(1e0, (log_time - fetch_u) / (0.6e0 * (finish_u - fetch_u))) end as lng
from (
  select *, accept_u + 30 * i as log_time, (event_id + i) % 211 = 0 as lost
  from (select *, unnest(range(0, 200)) as i from trips)
)
where log_time <= finish_u + case when event_id % 7 = 0 then 0 else 180 end

-- @table d_orders
select event_id as order_id, transporter_id, supplier_id, city_id * 100 + poi_k as receiver_id,
  case when event_id % 89 = 0 then '0000-00-00 00:00:00'
    else strftime(make_timestamp((fetch_u - case when event_id % 59 = 0 then 518400 when event_id % 67 = 0 then 691200 else 0 end) * 1000000),
      '%Y-%m-%d %H:%M:%S') end as fetch_time,
  case when event_id % 83 = 0 then '2019-01-31 16:00:00'
    else strftime(make_timestamp(finish_u * 1000000), '%Y-%m-%d %H:%M:%S') end as finish_time,
  r_lat as receiver_lat, r_lng as receiver_lng, s_lat as supplier_lat, s_lng as supplier_lng,
  case event_id % 6 when 0 then '望丛路12号' || (event_id % 30 + 1) || '楼'
    when 1 then '胸科医院3号楼八楼护士站'
    when 2 then '新港中路352号1803'
    when 3 then '负一楼'
    when 4 then '18号楼' || (event_id % 30 + 1) || 'D'
    else '二十三层' end as receiver_address,
  event_id % 5 as cargo_type_id, value as cargo_weight, value * 2 as cargo_amt,
  cast(event_id % 3 as double) as tips_amt, cast(event_id % 2 as double) as allowance_amt, city_id,
  strftime(make_timestamp(accept_u * 1000000), '%Y-%m-%d') as create_dt,
  case when event_id % 41 = 0 then 3 else 4 end as order_status,
  case when event_id % 43 = 0 then 'jdMall' else 'app' end as order_source_from
from trips

-- @table d_deliveries
select case when event_id % 109 = 0 then event_id - 1 else event_id end as delivery_id, transporter_id, supplier_id,
  case when event_id % 101 = 0 then 0e0 else cast(event_id % 3000 + 500 as double) end as distance,
  event_id % 5 as cargo_type_id,
  strftime(make_timestamp(accept_u * 1000000), '%Y-%m-%d %H:%M:%S') as accept_time,
  case when event_id % 89 = 0 then '0000-00-00 00:00:00'
    else strftime(make_timestamp(arrive_u * 1000000), '%Y-%m-%d %H:%M:%S') end as arrive_time,
  strftime(make_timestamp(case when event_id % 127 = 0 then arrive_u - 40 else fetch_u end * 1000000), '%Y-%m-%d %H:%M:%S') as fetch_time,
  strftime(make_timestamp(finish_u * 1000000), '%Y-%m-%d %H:%M:%S') as finish_time,
  city_id, strftime(make_timestamp(accept_u * 1000000), '%Y-%m-%d') as create_dt,
  case when event_id % 41 = 0 then 3 else 4 end as delivery_status,
  case when supplier_id % 20 = 19 then 5 else 1 end as supplier_type_id,
  case when event_id % 43 = 0 then 'jdMall' else 'app' end as delivery_source_from
from trips

-- @table d_suppliers
select supplier_id,
  case when supplier_id % 33 = 32 then 0e0
    else 30e0 + (supplier_id % 25) * 0.1e0 + (supplier_id // 25) * 0.01e0 end as supplier_lat,
  120e0 + (supplier_id % 25) * 0.1e0 as supplier_lng,
  case when supplier_id % 20 = 19 then 5 else 1 end as supplier_type_id
from (select distinct supplier_id from trips)

-- @table d_points
select distinct city_id, poi_k, case when poi_k = 5 then 4 else poi_k end as at_k from trips

-- @table d_poi_info
select 120e0 + city_id * 0.1e0 + 0.008e0 as lng,
  30e0 + city_id * 0.1e0 + poi_k * 0.01e0 + 0.005e0 as lat,
  'p' || city_id || '_' || at_k as poi_id,
  case when poi_k <> 7 then 'landmark ' || poi_k end as poi_name,
  cast(poi_k + 10 as double) as distance,
  30e0 + city_id * 0.1e0 + at_k * 0.01e0 + 0.005e0 + 0.0003e0 as poi_lat,
  120e0 + city_id * 0.1e0 + 0.008e0 as poi_lng,
  case when poi_k = 6 then 'street' else 'landmark_l2' end as poi_type
from d_points
union all
select 120e0 + city_id * 0.1e0 + 0.008e0, 30e0 + city_id * 0.1e0 + poi_k * 0.01e0 + 0.005e0,
  'q' || city_id || '_' || at_k, 'landmark ' || poi_k, 25e0,
  30e0 + city_id * 0.1e0 + at_k * 0.01e0 + 0.005e0 - 0.0003e0,
  120e0 + city_id * 0.1e0 + 0.008e0, 'landmark_l2'
from d_points where poi_k = 0

-- @table d_poi_difficulty
select 'p' || city_id || '_' || poi_k as poi_id,
  case when city_id % 5 <> 0 then cast(poi_k as int) end as difficulty
from d_points where poi_k in (1, 2)

-- @table d_log
select dt, 10604 as biz_type,
  head || '"pickupTimeValue":"' || case when event_id % 53 = 0 then 'n/a' else cast(arrive_u - accept_u + event_id % 120 as varchar) end || '"}' as data
from log_heads
union all
select dt, 10610,
  head || '"receiverTimeValue":"' || case when event_id % 53 = 0 then 'n/a' else cast(event_id % 200 + 100 as varchar) end || '"}'
from log_heads
union all
select dt, 10564,
  '{"order_id":"' || event_id || '","prob":"0.' || (event_id % 90 + 10) || '","dynamic_info":{"time_window_key":"w' || (event_id % 4)
  || '","overtime_allowance":' || (event_id % 6) || ',"tips":' || (event_id % 3) || ',"allowance":' || (event_id % 2) || '}}'
from log_heads

-- @table log_heads
select event_id, arrive_u, accept_u, strftime(make_timestamp(accept_u * 1000000), '%Y-%m-%d') as dt,
  '{"recOrderId":"r' || event_id || '","orderId":"' || event_id || '","isDowngrade":"' || (event_id % 2)
  || '","test_id":"' || case event_id % 3 when 0 then 'blank' when 1 then 'new' else 'other' end
  || '","cityId":"' || city_id || '","transporterId":"' || transporter_id || '","supplierLat":"30.' || city_id
  || '","now_timestamp":"' || accept_u || '",' as head
from trips

-- @table d_rating
select event_id, cast(transporter_id as varchar) as transporter_id,
  case when event_id % 37 = 0 then 'NULL' else cast((event_id * 17) % 2500 as varchar) end as score,
  cast(event_id % 5 + 1 as varchar) as grade, cast(event_id % 30 + 1 as varchar) as work_dt_cnt,
  cast((event_id * 13) % 16000 + 300 as varchar) as avg_dis,
  cast((event_id % 8) * 0.5e0 as varchar) as avg_speed,
  case when event_id % 29 = 0 then 'None' else cast(event_id % 3 as varchar) end as invalid_cnt,
  cast(event_id % 2 as varchar) as not_first_invalid,
  case when event_id % 61 = 0 then 'yes' when event_id % 7 = 0 then '1' else '0' end as invalid_label
from trips where event_id % 71 <> 0

-- @table d_scored
select event_id as order_id, case when event_id % 7 = 0 then 1 else -1 end as label,
  ((event_id * 7919 + case when event_id % 7 = 0 then 400 else 0 end) % 997) / 997e0 as score
from trips
