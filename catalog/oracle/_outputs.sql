-- @table g1
select order_scan.*, logging_unixtime as report_unixtime
from coords join order_scan on coords.user_id = order_scan.transporter_id
  and logging_unixtime > fetch_time_unix and logging_unixtime <= finish_time_unix
where haversine_m(r_lng, r_lat, lng, lat) < 80

-- @table g4
with stay as (
  select order_id, any_value(transporter_id) as transporter_id, any_value(supplier_id) as supplier_id,
    any_value(receiver_id) as receiver_id, any_value(city_id) as city_id, any_value(finish_time) as finish_time,
    any_value(finish_time_unix) as finished, any_value(r_lng) as r_lng, any_value(r_lat) as r_lat,
    any_value(s_r_line_distance) as s_r_line_distance, any_value(receiver_address) as receiver_address,
    any_value(cargo_type_id) as cargo_type_id, any_value(cargo_weight) as cargo_weight,
    min(report_unixtime) as entered, max(report_unixtime) as left_at, count(*) as point_cnt
  from g1 group by order_id)
select * exclude (finished, entered, left_at), finished - entered as delivery_time1, left_at - entered as delivery_time2
from stay where finished - entered <= 800

-- @table g5
with point as (select *, printf('%.5f_%.5f', lng, lat) as spot from d_poi_info where poi_name is not null and poi_type = 'landmark_l2')
select g4.*, point.poi_id, poi_name, distance, poi_lat, poi_lng,
  cast(hard.poi_id is not null as int) as is_hard_poi, coalesce(difficulty, 0) as difficulty
from g4 join point on printf('%.5f_%.5f', r_lng, r_lat) = spot left join d_poi_difficulty hard on hard.poi_id = point.poi_id
where point_cnt > 2 and delivery_time1 > 15

-- @table g6
select poi_id, city_id, poi_lat, poi_lng, count(*) as order_cnt,
  median(delivery_time1) as percentile_delivery_time_poi, median(cast(floor(distance) as int)) as percentile_distance_poi,
  round(avg(delivery_time1), 1) as avg_delivery_time_poi, stddev_pop(distance) as std_distance_poi,
  stddev_pop(delivery_time1) as std_delivery_time_poi
from g5 group by all having order_cnt >= 5

-- @table g8
select order_id, city_id, transporter_id, supplier_id, receiver_id, finish_time, receiver_address, cargo_type_id, cargo_weight,
  s_r_line_distance, r_lng, r_lat, delivery_time1, delivery_time2, is_hard_poi, difficulty, distance as receiver_poi_distance,
  poi_id, poi_lat, poi_lng, percentile_delivery_time_poi, avg_delivery_time_poi, percentile_distance_poi,
  std_distance_poi, std_delivery_time_poi, order_cnt, abs(percentile_delivery_time_poi - delivery_time1) as error1,
  abs(percentile_delivery_time_poi - delivery_time2) as error2, t_history_order_num, t_avg_a1_time, t_avg_a2_time
from g5 join g6 using (poi_id, city_id, poi_lat, poi_lng) join courier_means using (transporter_id, city_id)

-- @table g9
with timed as (select g8.*, peek_time from g8 join hour_classes on hour(finish_time::timestamp) = h)
select transporter_id, city_id, count(*) as delivery_cnt,
  cast(floor(avg(delivery_time1)) as int) as avg_delivery_time1, median(delivery_time1) as per_delivery_time1,
  cast(floor(avg(delivery_time2)) as int) as avg_delivery_time2, median(delivery_time2) as per_delivery_time2,
  count(*) filter (peek_time = 1) as cnt_peek1, count(*) filter (peek_time = 2) as cnt_peek2,
  count(*) filter (peek_time = 3) as cnt_peek3, count(*) filter (peek_time = 0) as cnt_peek0,
  median(delivery_time1) filter (peek_time = 1) as per_delivery_time1_peek1,
  median(delivery_time1) filter (peek_time = 2) as per_delivery_time1_peek2,
  median(delivery_time1) filter (peek_time = 3) as per_delivery_time1_peek3,
  median(delivery_time1) filter (peek_time = 0) as per_delivery_time1_peek0
from timed group by transporter_id, city_id

-- @table g10
select * from g8 join g9 using (transporter_id, city_id)

-- @table log_values
select dt, biz_type, json_extract_string(data, '$.recOrderId') as recorderid,
  json_extract_string(data, '$.orderId') as orderid,
  try_cast(json_extract_string(data, '$.pickupTimeValue') as int) as pickuptimevalue,
  try_cast(json_extract_string(data, '$.receiverTimeValue') as int) as receivertimevalue,
  json_extract_string(data, '$.isDowngrade') as isdowngrade,
  json_extract_string(data, '$.test_id') as test_id,
  json_extract_string(data, '$.cityId') as cityid,
  json_extract_string(data, '$.transporterId') as transporterid,
  json_extract_string(data, '$.now_timestamp') as now_timestamp
from d_log where biz_type <> 10564

-- @table ab_a
select t1.recorderid, t1.orderid, t1.pickuptimevalue, t1.isdowngrade, t1.test_id, t1.cityid, t1.transporterid,
  t2.supplier_id, t2.supplier_type_id, t2.cargo_type_id, t2.accept_time, t2.arrive_time, t2.fetch_time,
  t2.real_time_line_distance, t2.a_time, t2.a1_time, t2.a2_time, t2.city_id
from log_values t1 join a1 t2 on cast(t1.orderid as bigint) = t2.delivery_id
  and cast(t1.transporterid as bigint) = t2.transporter_id
where t1.biz_type = 10604

-- @table m1
select order_rows.*, logging_unixtime as report_unixtime, create_dt as order_day, log_dt
from coords join order_rows on coords.user_id = order_rows.transporter_id
  and logging_unixtime > fetch_time_unix and logging_unixtime <= finish_time_unix + 120
where haversine_m(r_lng, r_lat, lng, lat) < 80

-- @table m4
with stay as (
  select order_id, any_value(transporter_id) as transporter_id, any_value(finish_time_unix) as finished,
    any_value(receiver_address) as receiver_address, any_value(cargo_type_id) as cargo_type_id,
    any_value(cargo_weight) as cargo_weight, min(report_unixtime) as entered, max(report_unixtime) as left_at, count(*) as point_cnt
  from m1 group by order_id)
select * exclude (finished, entered, left_at), finished - entered as delivery_time1, left_at - entered as delivery_time2
from stay where finished - entered <= 800 and point_cnt > 1 and finished > entered and left_at > finished

-- @table ab_c
select t1.receivertimevalue, t1.recorderid, t1.orderid, t1.isdowngrade, t1.test_id, t1.cityid, t1.transporterid,
  t1.now_timestamp, t2.delivery_time2, t2.delivery_time1, t2.receiver_address, t2.cargo_type_id, t2.cargo_weight
from log_values t1 join m4 t2 on cast(t1.orderid as bigint) = t2.order_id
  and cast(t1.transporterid as bigint) = t2.transporter_id
where t1.biz_type = 10610

-- @table f_handover
select order_id, cargo_type_id, city_id, cast(h as varchar) as hour,
  cargo_weight, percentile_delivery_time_poi, avg_delivery_time_poi, percentile_distance_poi, std_distance_poi, std_delivery_time_poi, order_cnt, t_history_order_num, t_avg_a1_time, t_avg_a2_time, delivery_cnt, avg_delivery_time2, per_delivery_time2, cnt_peek1, cnt_peek2, cnt_peek3, cnt_peek0, per_delivery_time_peek1, per_delivery_time_peek2, per_delivery_time_peek3, per_delivery_time_peek0,
  case when h in (11, 12, 18, 19) then cnt_peek1 when h in (9, 10, 15, 16, 20, 21) then cnt_peek2
    when h < 9 or h = 23 then cnt_peek3 else cnt_peek0 end as current_cnt_peek,
  case when h in (11, 12, 18, 19) then per_delivery_time_peek1 when h in (9, 10, 15, 16, 20, 21) then per_delivery_time_peek2
    when h < 9 or h = 23 then per_delivery_time_peek3 else per_delivery_time_peek0 end as current_per_delivery_time_peek,
  label
from (
  select cast(order_id as varchar) as order_id, cast(cargo_type_id as varchar) as cargo_type_id,
    cast(city_id as varchar) as city_id, hour(finish_time::timestamp) as h,
    cast(cargo_weight as double) as cargo_weight, cast(percentile_delivery_time_poi as double) as percentile_delivery_time_poi, cast(avg_delivery_time_poi as double) as avg_delivery_time_poi, cast(percentile_distance_poi as double) as percentile_distance_poi, cast(std_distance_poi as double) as std_distance_poi, cast(std_delivery_time_poi as double) as std_delivery_time_poi, cast(order_cnt as double) as order_cnt, cast(t_history_order_num as double) as t_history_order_num, cast(t_avg_a1_time as double) as t_avg_a1_time, cast(t_avg_a2_time as double) as t_avg_a2_time,
    cast(coalesce(trunc(delivery_cnt), -1) as bigint) as delivery_cnt, cast(coalesce(trunc(avg_delivery_time2), -1) as bigint) as avg_delivery_time2, cast(coalesce(trunc(per_delivery_time2), -1) as bigint) as per_delivery_time2, cast(coalesce(trunc(cnt_peek1), -1) as bigint) as cnt_peek1, cast(coalesce(trunc(cnt_peek2), -1) as bigint) as cnt_peek2, cast(coalesce(trunc(cnt_peek3), -1) as bigint) as cnt_peek3, cast(coalesce(trunc(cnt_peek0), -1) as bigint) as cnt_peek0, cast(coalesce(trunc(per_delivery_time_peek1), -1) as bigint) as per_delivery_time_peek1, cast(coalesce(trunc(per_delivery_time_peek2), -1) as bigint) as per_delivery_time_peek2, cast(coalesce(trunc(per_delivery_time_peek3), -1) as bigint) as per_delivery_time_peek3, cast(coalesce(trunc(per_delivery_time_peek0), -1) as bigint) as per_delivery_time_peek0,
    cast(delivery_time2 as double) as label
  from c10)

-- @table f_pickup
select delivery_id, cargo_type_id, city_id, hour, weekday,
  case when weekday in ('5', '6') then '1' else '0' end as is_weekend,
  case when real_time_line_distance > 200 then '1' else '0' end as is_over200m,
  case when real_time_line_distance > 20 then '1' else '0' end as is_over20m,
  real_time_line_distance, t_history_order_num, t_avg_a1_time, t_avg_a2_time, s_history_order_num, s_avg_a1_time, s_avg_a2_time, cargo_weight,
  real_time_line_distance / speed as old_a1, s_avg_a2_time as old_a2, label_a1, label_a2
from (
  select cast(delivery_id as varchar) as delivery_id, cast(cargo_type_id as varchar) as cargo_type_id,
    cast(city_id as varchar) as city_id, cast(hour(finish_time::timestamp) as varchar) as hour,
    cast(isodow(finish_time::timestamp) - 1 as varchar) as weekday,
    cast(real_time_line_distance as double) as real_time_line_distance, cast(t_history_order_num as double) as t_history_order_num, cast(t_avg_a1_time as double) as t_avg_a1_time, cast(t_avg_a2_time as double) as t_avg_a2_time, cast(s_history_order_num as double) as s_history_order_num, cast(s_avg_a1_time as double) as s_avg_a1_time, cast(s_avg_a2_time as double) as s_avg_a2_time, cast(cargo_weight as double) as cargo_weight,
    -- Mean courier speed by city. Fixed values; the cities here are 0 to 24.
    case city_id
    when 0 then 4.5e0
    when 1 then 4.670976602114164e0
    when 2 then 4.817198349879338e0
    when 3 then 4.800101683689998e0
    when 4 then 4.544530281653771e0
    when 5 then 4.9441774258246785e0
    when 6 then 4.165272254210252e0
    when 7 then 4.799496577336238e0
    when 8 then 4.8642904208256645e0
    when 9 then 4.650193526194646e0
    when 10 then 3.8875846679394064e0
    when 11 then 3.7497491469750037e0
    when 12 then 4.639689977352436e0
    when 13 then 4.459546125852144e0
    when 14 then 4.416226698802068e0
    when 15 then 4.6933662707989035e0
    when 16 then 4.3487566984616794e0
    when 17 then 4.409211415510911e0
    when 18 then 4.839935651192298e0
    when 19 then 5.089973101249108e0
    when 21 then 5.016223577352671e0
    when 22 then 4.828889865141648e0
    when 23 then 4.560015036509587e0
    when 24 then 4.480501706783588e0
    else 4.5e0 end as speed,
    cast(a1_time as double) as label_a1, cast(a2_time as double) as label_a2
  from a3)
where label_a1 > 0 and label_a2 > 0

-- @table f_rating
select transporter_id, grade, work_dt_cnt, not_first_invalid,
  least(1e0, score / 2000e0) as score,
  least(1e0, (avg_dis - 500e0) / 14500e0) as avg_dis,
  least(1e0, (avg_speed - 0.5e0) / 3.5e0) as avg_speed,
  least(1e0, score / avg_speed / 1000e0) as "score/avg_speed",
  least(1e0, cast(grade as double) / avg_speed / 5e0) as "grade/avg_speed",
  label
from (
  select transporter_id, grade, work_dt_cnt, not_first_invalid, cast(score as double) as score,
    cast(avg_dis as double) as avg_dis, cast(avg_speed as double) as avg_speed,
    case when invalid_label = '1' then 1 else -1 end as label
  from d_rating where cast(avg_speed as double) <> 0 and invalid_label <> 'yes' and score <> 'NULL')
