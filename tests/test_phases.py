"""Hand-made cases of both phases, checked by hand or against plain Python."""

import math
import random

from pyspark.sql import functions as F

from doorclock import fixtures as fx
from doorclock import settings as S
from doorclock.functions.geo import METRES_PER_DEGREE
from doorclock.operators import first_ping, geofence, history, peak, poi
from doorclock.plans import audited, phase_a, phase_c

DATES = S.DateRange("2024-01-01", "2024-01-31")
BASE = 1704067200  # 2024-01-01 00:00 UTC

ORDER = (
    "order_id long, transporter_id long, supplier_id long, receiver_id long, fetch_time_unix long, "
    "finish_time_unix long, finish_time string, r_lat double, r_lng double, s_r_line_distance double, "
    "receiver_address string, cargo_type_id long, cargo_weight double, city_id long"
)
PING = "user_id long, lat double, lng double, log_time long"


def order(i, courier, fetch, finish, lat=30.0, lng=120.0):
    return (i, courier, 1, 1, fetch, finish, "2024-01-01 12:00:00", lat, lng, 0.0, "", 1, 1.0, 1)


def in_circle(spark, orders, pings, rules=S.CURRENT):
    return geofence.pings_in_circle(spark.createDataFrame(orders, ORDER), spark.createDataFrame(pings, PING), rules)


def test_window_and_circle_edges(spark):
    fetch, finish = BASE + 100, BASE + 1000
    inside, outside = 30.0 + 79.9 / METRES_PER_DEGREE, 30.0 + 80.1 / METRES_PER_DEGREE
    pings = [
        (7, 30.0, 120.0, fetch),  # at the fetch time: out
        (7, 30.0, 120.0, fetch + 1),  # in
        (7, inside, 120.0, finish),  # in
        (7, outside, 120.0, finish + 1),  # outside the circle
        (7, 30.0, 120.0, finish + 120),  # last second: in
        (7, 30.0, 120.0, finish + 121),  # out
        (8, 30.0, 120.0, finish),  # another courier
    ]
    got = in_circle(spark, [order(1, 7, fetch, finish)], pings).select("report_unixtime").collect()
    assert sorted(t for (t,) in got) == [fetch + 1, finish, finish + 120]
    first = in_circle(spark, [order(1, 7, fetch, finish)], pings, S.FIRST_GENERATION)
    assert sorted(r["report_unixtime"] for r in first.collect()) == [fetch + 1, finish]


def test_geofence_join_agrees_with_brute_force(spark):
    rng = random.Random(11)
    # A third of everything belongs to courier 1; points lie on both sides of cell edges and of the
    # date line; one order has no real fetch time, one lasts several hours.
    places = [(30.0, 120.0), (29.9996, 120.0099), (10.0, 179.9999), (60.0, -179.9997)]
    orders, pings = [], []
    for i in range(120):
        lat, lng = rng.choice(places)
        fetch = BASE + rng.randrange(20000)
        courier = 1 if i % 3 == 0 else rng.randrange(2, 9)
        orders.append(order(i, courier, fetch, fetch + rng.randrange(60, 1500), lat, lng))
    orders.append(order(900, 1, S.ZERO_DATE_EPOCH, BASE + 9000, *places[0]))
    orders.append(order(901, 1, BASE, BASE + 15000, *places[2]))
    for _ in range(3000):
        lat, lng = rng.choice(places)
        lat, lng = lat + rng.uniform(-0.001, 0.001), lng + rng.uniform(-0.0015, 0.0015)
        lng = lng - 360 if lng > 180 else lng + 360 if lng < -180 else lng
        courier = 1 if rng.random() < 0.34 else rng.randrange(2, 9)
        pings.append((courier, lat, lng, BASE + rng.randrange(22000)))
    pings = sorted(set(pings))

    def metres(lng1, lat1, lng2, lat2):
        p1, p2 = math.radians(lat1), math.radians(lat2)
        a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(a))

    expected = sorted(
        (o[0], p[3], p[1])
        for o in orders
        for p in pings
        if o[1] == p[0] and o[4] < p[3] <= o[5] + 120 and metres(o[8], o[7], p[2], p[1]) < 80
    )
    got = in_circle(spark, orders, pings).select("order_id", "report_unixtime", "t_lat").collect()
    assert len(expected) > 250
    assert sorted(map(tuple, got)) == expected


def test_dwell_rules(spark):
    fetch, finish = BASE, BASE + 1000
    enter = finish - 200

    def at(order_id, *times):
        return order(order_id, order_id, fetch, finish), [(order_id, 30.0, 120.0, t) for t in times]

    cases = [
        at(1, enter, finish + 60),  # kept
        at(2, enter, finish),  # time2 equals time1: dropped
        at(3, finish + 10, finish + 60),  # entered after finishing: dropped
        at(4, finish + 60),  # a single position: dropped
        at(5, finish - 801, finish + 60),  # over-dwell: dropped
        at(6, finish - 800, finish + 60),  # exactly the limit: kept
    ]
    orders = spark.createDataFrame([o for o, _ in cases], ORDER)
    found = in_circle(spark, [o for o, _ in cases], [p for _, ps in cases for p in ps])
    got = {r["order_id"]: (r["delivery_time1"], r["delivery_time2"], r["point_cnt"]) for r in geofence.dwell(found, orders).collect()}
    assert got == {1: (200, 260, 2), 6: (800, 860, 2)}
    older = geofence.dwell(found, orders, S.FIRST_GENERATION).collect()
    assert {r["order_id"] for r in older} == {1, 2, 3, 4, 6}


def test_one_pass_dwell_equals_the_stepwise_flow(spark, tiny):
    found, orders = phase_c.in_circle(fx.warehouse(spark, tiny), fx.DATES, fx.ZONE)
    ranked = geofence.ranked_pings(geofence.with_orders(found, orders), fx.ZONE)
    rejected = geofence.overdwell_orders(ranked)
    kept = geofence.without_orders(ranked, rejected)
    narrow = found.join(kept.select("order_id").distinct(), "order_id", "left_semi")
    stepwise = geofence.stays(narrow, orders).where(geofence.valid_stay()).drop("finish_time_unix")
    fused = geofence.dwell(found, orders)
    assert sorted(map(tuple, stepwise.collect())) == sorted(map(tuple, fused.collect()))
    gone = {r["order_id"] for r in rejected.select("order_id").collect()}
    assert gone and not gone & {r["order_id"] for r in kept.select("order_id").distinct().collect()}


def test_windows_of_days_find_late_positions(spark):
    day, finish = 86400, BASE + 20 * 86400
    lengths = {1: 6, 2: 8, 3: 7, 4: 400, 5: 0}
    orders = [order(i, 7, finish - days * day - 60, finish) for i, days in lengths.items()]
    pings = [(7, 30.0, 120.0, finish - k * day // 2) for k in range(800)]
    got = in_circle(spark, orders, pings).groupBy("order_id").count().collect()
    want = {i: sum(finish - d * day - 60 < t <= finish + 120 for _, _, _, t in pings) for i, d in lengths.items()}
    assert {r["order_id"]: r["count"] for r in got} == want
    plan = in_circle(spark, orders, pings)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in plan and str(geofence.ALL_TIME) in plan


def test_positions_are_not_repeated(spark):
    orders = [order(1, 7, BASE, BASE + 500), order(2, 7, BASE - 90 * 86400, BASE + 500)]
    found = in_circle(spark, orders, [(7, 30.0, 120.0, BASE + 400), (7, 30.0, 120.0, BASE - 40 * 86400), (8, 30.0, 120.0, BASE)])
    assert sorted((r.order_id, r.report_unixtime) for r in found.collect()) == [(1, BASE + 400), (2, BASE - 40 * 86400), (2, BASE + 400)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3  # blocks and cells of orders


def test_overdwell_in_one_pass_equals_the_stepwise_flow(spark):
    orders = [order(k % 17, 7 + k % 2, BASE + 40 * k, BASE + 40 * k + 900 * (k % 4)) for k in range(40)]
    pings = [(7 + k % 2, 30.0, 120.0, BASE + 13 * k) for k in range(300)]
    ranked = geofence.ranked_pings(geofence.with_orders(in_circle(spark, orders, pings), spark.createDataFrame(orders, ORDER)))
    want = geofence.without_orders(ranked, geofence.overdwell_orders(ranked))
    got = sorted(map(str, geofence.without_overdwell(ranked).collect()))
    assert got == sorted(map(str, want.collect())) and 0 < len(got) < ranked.count()


def test_orders_that_share_an_id_keep_their_own_stay(spark):
    orders = [order(1, 7, BASE, BASE + 500), order(1, 8, BASE, BASE + 900)]
    pings = [(7, 30.0, 120.0, BASE + 400), (7, 30.0, 120.0, BASE + 550), (8, 30.0, 120.0, BASE + 700), (8, 30.0, 120.0, BASE + 950)]
    got = geofence.dwell(in_circle(spark, orders, pings), spark.createDataFrame(orders, ORDER)).collect()
    assert sorted((r.transporter_id, r.delivery_time1, r.delivery_time2) for r in got) == [(7, 100, 150), (8, 200, 250)]


def test_one_row_per_delivery_id_of_the_row_that_owns_the_position(spark):
    schema = "delivery_id long, transporter_id long, accept_time_unix long, fetch_time_unix long"
    deliveries = spark.createDataFrame([(1, 7, BASE, BASE + 50), (1, 8, BASE + 100, BASE + 400), (2, 7, BASE, BASE + 3 * 86400)], schema)
    pings = spark.createDataFrame([(7, 1.0, 1.0, BASE + 60), (8, 2.0, 2.0, BASE + 90), (8, 3.0, 3.0, BASE + 300)], PING)
    got = first_ping.first_pings(deliveries, pings).collect()
    assert sorted((r.delivery_id, r.transporter_id, r.log_time) for r in got) == [(1, 8, BASE + 300), (2, 7, BASE + 60)]


def test_deliveries_are_scanned_once_and_not_repeated(spark, tmp_path):
    schema = "delivery_id long, transporter_id long, accept_time_unix long, fetch_time_unix long"
    spark.createDataFrame([(1, 7, BASE, BASE + 9 * 86400)], schema).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(7, 1.0, 1.0, BASE + 60)], PING).write.parquet(str(tmp_path / "p"))
    found = first_ping.first_pings(spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "p")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [delivery_id") == 1 and "Generate" not in plan and "Join" not in plan


def test_positions_are_read_and_moved_once(spark, tmp_path):
    schema = "delivery_id long, transporter_id long, accept_time_unix long, fetch_time_unix long"
    deliveries = spark.createDataFrame([(1, 7, BASE, BASE + 9 * 86400)], schema)
    spark.createDataFrame([(7, 1.0, 1.0, BASE + 7200), (7, 2.0, 2.0, BASE + 7200)], PING).write.parquet(str(tmp_path / "p"))
    found = first_ping.first_pings(deliveries, spark.read.parquet(str(tmp_path / "p")))
    assert [(r.log_time, r.lat) for r in found.collect()] == [(BASE + 7200, 1.0)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_positions_are_sorted_once_in_small_shares(spark):
    deliveries = spark.range(1).selectExpr(
        "id as delivery_id", "id as transporter_id", "id as accept_time_unix", "id + 9 as fetch_time_unix"
    )
    pings = spark.range(1).selectExpr("id as user_id", "id as log_time", "1D as lat", "1D as lng")
    plan = first_ping.first_pings(deliveries, pings)._jdf.queryExecution().executedPlan().toString()
    shares = first_ping.TIMES_FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan.count("Window [") == 2  # by hour, and by courier
    assert plan.count(f", {shares}), REPARTITION_BY_NUM") == 2


def test_first_position_after_days(spark):
    schema = "delivery_id long, transporter_id long, accept_time_unix long, fetch_time_unix long"
    rng = random.Random(8)
    trips = [(i, i % 4, BASE + rng.randrange(9 * 86400), 0) for i in range(120)]
    trips = [(i, c, a, a + rng.choice([300, 5000, 90000, 500000])) for i, c, a, _ in trips]
    pings = [(rng.randrange(4), float(k % 3), 1.0, BASE + rng.randrange(12 * 86400)) for k in range(60)]
    want = {i: min(h)[0] for i, c, a, f in trips if (h := [(t, lat, lng) for u, lat, lng, t in pings if u == c and a <= t <= f])}
    got = first_ping.first_pings(spark.createDataFrame(trips, schema), spark.createDataFrame(pings, PING)).collect()
    assert {r.delivery_id: r.log_time for r in got} == want


def test_first_pings_agree_with_brute_force(spark):
    rng = random.Random(5)
    trips = []
    for i in range(150):
        accept = BASE + rng.randrange(6000)
        trips.append((i, 1 if i % 3 == 0 else rng.randrange(2, 6), accept, accept + rng.randrange(-50, 2200)))
    pings = [
        (1 if rng.random() < 0.34 else rng.randrange(2, 6), float(rng.randrange(3)), float(rng.randrange(3)), BASE + rng.randrange(9000))
        for _ in range(250)
    ]
    expected = {}
    for i, courier, accept, fetch in trips:
        hits = [(t, lat, lng) for c, lat, lng, t in pings if c == courier and accept <= t <= fetch]
        if hits:
            expected[i] = min(hits)
    deliveries = spark.createDataFrame(
        trips, "delivery_id long, transporter_id long, accept_time_unix long, fetch_time_unix long"
    )
    got = first_ping.first_pings(deliveries, spark.createDataFrame(pings, PING)).collect()
    assert {r["delivery_id"]: (r["log_time"], r["lat"], r["lng"]) for r in got} == expected
    assert len(expected) > 80


def test_libraries_move_positions_for_some_couriers_at_a_time(spark, tiny, monkeypatch):
    """Each share is written, and what it left on disk released, before the next one; together they are the whole."""
    seen, real = [], audited.staged
    monkeypatch.setattr(audited, "staged", lambda df, name: (seen.append((name, real(df, name))), seen[-1][1])[1])
    monkeypatch.setattr(audited, "released", lambda spark: seen.append(("released", None)))
    monkeypatch.setattr(audited, "dropped", lambda table: None)
    wh = fx.warehouse(spark, tiny)
    got = audited.libraries(wh, fx.DATES, fx.ZONE)
    for name, courier, want in (
        ("stays", "transporter_id", geofence.stays(*phase_c.in_circle(wh, fx.DATES, fx.ZONE))),
        ("first-positions", "delivery.transporter_id", None),
    ):
        at = [k for k, (n, _) in enumerate(seen) if n == name]
        assert len(at) == audited.SHARES > 1 and all(seen[k + 1][0] == "released" for k in at)
        couriers = [{r[0] for r in seen[k][1].select(courier).collect()} for k in at]
        assert all(couriers) and len(set.union(*couriers)) == sum(map(len, couriers))
        if want is not None:
            assert sorted(map(str, want.collect())) == sorted(str(r) for k in at for r in seen[k][1].collect())
    want = phase_a.accepted_positions(wh, fx.DATES, fx.ZONE)
    assert sorted(map(str, got.accepted.collect())) == sorted(map(str, want.collect()))


def test_shares_of_couriers_whose_ids_differ_in_type(spark):
    """Every position meets its courier, whatever the tables name them by; a delivery id of two couriers stays one."""
    schema = "delivery_id long, transporter_id long, accept_time_unix long, fetch_time_unix long"
    deliveries = [(c // 2, c, BASE + c, BASE + c + 500) for c in range(40)] + [(99, None, BASE, BASE + 500)]
    pings = [(c, 1.0, float(c), BASE + c + 10 + c % 2) for c in range(40)] + [(None, 1.0, 7.0, BASE + 3)]
    left = spark.createDataFrame(deliveries, schema)
    for kind in ("long", "int", "string", "double"):
        right = spark.createDataFrame(pings, PING).withColumn("user_id", F.col("user_id").cast(kind) if kind != "string" else F.col("user_id").cast("string"))
        shares = [first_ping.found_pings(*pair) for pair in audited._shares(left, right)]
        whole = first_ping.first_pings(left, right)
        together = shares[0]
        for share in shares[1:]:
            together = together.unionByName(share)
        key = ["delivery_id", "transporter_id", "log_time", "lng"]
        assert sorted(map(str, first_ping.earliest(together).select(key).collect())) == sorted(map(str, whole.select(key).collect()))
        assert whole.count() == 21


def test_single_city_owners(spark):
    rows = [(1, 5, 10, 1.0, 2.0), (2, 5, 1, 3.0, 4.0), (2, 6, 1, 5.0, 6.0)]
    df = spark.createDataFrame(
        rows, "supplier_id long, city_id long, history_order_num long, avg_a1_time double, avg_a2_time double"
    )
    assert [tuple(r) for r in history.single_city(df, "supplier_id").collect()] == [rows[0]]
    assert [tuple(r) for r in history.multi_city_owners(df, "supplier_id").collect()] == [(2, 2)]


STAY = (
    "order_id long, transporter_id long, city_id long, finish_time string, delivery_time1 long, "
    "delivery_time2 long, point_cnt long, r_lng double, r_lat double"
)


def test_courier_peak(spark):
    rows = [
        (1, 1, 1, "2024-01-01 11:59:59", 10, 100, 3, 0.0, 0.0),
        (2, 1, 1, "2024-01-01 12:00:00", 20, 203, 3, 0.0, 0.0),
        (3, 1, 1, "2024-01-01 13:00:00", 30, 60, 3, 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, STAY)
    got = peak.courier_peak(df).first().asDict()
    assert got["delivery_cnt"] == 3 and got["avg_delivery_time2"] == 121 and got["per_delivery_time2"] == 100
    assert (got["cnt_peek1"], got["per_delivery_time_peek1"]) == (2, 151)
    assert (got["cnt_peek0"], got["per_delivery_time_peek0"]) == (1, 60)
    assert (got["cnt_peek3"], got["per_delivery_time_peek3"]) == (0, None)
    assert sum(got[f"cnt_peek{c}"] for c in range(4)) == got["delivery_cnt"]
    median = peak.courier_peak(df, S.DwellRules(peak_median=True)).first()
    assert median["per_delivery_time_peek1"] == 151.5
    older = peak.courier_peak(df, S.FIRST_GENERATION).first()
    assert older["per_delivery_time1_peek1"] == 15.0 and older["avg_delivery_time1"] == 20


def test_landmarks(spark):
    stays = [(i, 1, 1, "2024-01-01 12:00:00", 10, 40 + i, 3, 120.000004, 30.0) for i in range(5)]
    stays += [(10 + i, 1, 1, "2024-01-01 12:00:00", 10, 40, 3, 121.0, 30.0) for i in range(4)]
    stays += [(20, 1, 1, "2024-01-01 12:00:00", 10, 30, 3, 120.0, 30.0), (21, 1, 1, "2024-01-01 12:00:00", 10, 90, 2, 120.0, 30.0)]
    df = spark.createDataFrame(stays, STAY)
    pois = spark.createDataFrame(
        [
            (120.0, 30.0, "a", "A", 12.0, 30.1, 120.1),
            (120.0, 30.0, "b", "B", 14.0, 30.2, 120.2),
            (121.0, 30.0, "c", "C", 16.0, 30.3, 120.3),
        ],
        "lng double, lat double, poi_id string, poi_name string, distance double, poi_lat double, poi_lng double",
    )
    difficulty = spark.createDataFrame([("a", 2), ("b", None)], "poi_id string, difficulty int")
    bound = poi.bind_landmarks(df, pois, difficulty)
    got = sorted((r["order_id"], r["poi_id"], r["is_hard_poi"], r["difficulty"]) for r in bound.collect())
    assert got == sorted(
        [(i, "a", 1, 2) for i in range(5)] + [(i, "b", 1, 0) for i in range(5)] + [(10 + i, "c", 0, 0) for i in range(4)]
    )
    stats = {r["poi_id"]: r for r in poi.poi_statistics(bound).collect()}
    assert set(stats) == {"a", "b"}  # five orders are enough, four are not
    assert stats["a"]["percentile_delivery_time_poi"] == 42.0
    assert stats["a"]["std_delivery_time_poi"] ** 2 == 2.0 or math.isclose(stats["a"]["std_delivery_time_poi"], math.sqrt(2))
    assert stats["a"]["order_cnt"] == 5 and stats["a"]["std_distance_poi"] == 0.0


def test_scan_filters(spark, tiny):
    wh = fx.warehouse(spark, tiny)
    from doorclock.sources import tables

    scanned = tables.order_scan(wh.orders, fx.DATES, fx.ZONE)
    assert scanned.where(F.col("finish_time_unix") == S.UNSET_TIME_EPOCH).isEmpty()
    unfiltered = tables.order_scan(wh.orders, fx.DATES, fx.ZONE, drop_sentinel_times=False)
    assert unfiltered.count() > scanned.count()
    one_day = tables.order_scan(wh.orders, S.DateRange("2024-01-02", "2024-01-02"), fx.ZONE)
    assert {r[0] for r in one_day.select("create_dt").distinct().collect()} == {"2024-01-02"}


def test_times_are_parsed_once(spark, tiny):
    wh = fx.warehouse(spark, tiny)
    from doorclock.sources import tables

    orders = tables.order_scan(wh.orders, fx.DATES, fx.ZONE).where("fetch_time_unix <= finish_time_unix")
    deliveries = tables.delivery_scan(wh.deliveries, fx.DATES, fx.ZONE).where("accept_time_unix <= fetch_time_unix")
    for scanned, texts in ((orders, 2), (deliveries, 4)):
        assert scanned._jdf.queryExecution().optimizedPlan().toString().count("try_cast(") == texts
