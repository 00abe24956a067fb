"""Warehouse-shaped tables derived from the `events` table, for tests, checks and the benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorclock import settings as S
from doorclock.functions.times import date_of_epoch, epoch_of_ntz, format_epoch
from doorclock.plans.staging import staged

ZONE = "UTC"
DATES = S.DateRange("2024-01-01", "2024-02-01")
RUN_TIME = "2024-02-02 00:00:00"
DAY_S = 86400


def _case(test: Column, yes, no) -> Column:
    return F.when(test, yes).otherwise(no)


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the narrow rows out: the wide texts and positions are derived from them."""
    return df.repartition(key)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per event: who, where and four unix times."""
    prepared = _PREPARED.get((spark.sparkContext.applicationId, sf_dir))
    if prepared:
        return prepared["trips"]
    e = F.col("event_id")
    city, poi = F.col("city_id"), F.col("poi_k")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A one-row generator: filters on texts derived from the time stay above the spread.
    accepted = F.inline(F.array(F.struct(epoch_of_ntz(F.col("ts")).alias("accept_u"))))
    return (
        _spread(events.select("event_id", "ts", "user_id", "value"), "event_id")
        .select("event_id", "value", F.col("user_id").alias("transporter_id"), accepted)
        .withColumns(
            {
                "city_id": _case(e % 97 == 0, (F.col("transporter_id") + 1) % 25, F.col("transporter_id") % 25),
                "supplier_id": F.col("transporter_id") % 25 + 25 * (e % 4),
                "poi_k": _case(e % 31 == 0, 8, e % 8),
                "arrive_u": F.col("accept_u") + 60 + (e * 37) % 600,
            }
        )
        .withColumn("fetch_u", F.col("arrive_u") + 30 + (e * 53) % 500)
        .withColumn("finish_u", F.col("fetch_u") + 120 + (e * 71) % 600 + _case(e % 50 == 0, 3000, 0))
        .withColumns(
            {
                "s_lat": F.lit(30.0) + city * F.lit(0.1) + (e % 4) * F.lit(0.01),
                "s_lng": F.lit(120.0) + city * F.lit(0.1),
                "r_lat": F.lit(30.0) + city * F.lit(0.1) + poi * F.lit(0.01) + F.lit(0.005),
                "r_lng": F.lit(120.0) + city * F.lit(0.1) + F.lit(0.008),
            }
        )
    )


def coords(trips: DataFrame) -> DataFrame:
    """A position every 30 s: approach to the shop, wait, ride to the receiver, stay there."""
    order, step = F.col("event_id"), F.col("i")
    accept, arrive, fetch, finish = (F.col(c) for c in ("accept_u", "arrive_u", "fetch_u", "finish_u"))
    time = accept + 30 * step
    last = finish + _case(order % 7 == 0, 0, 180)
    ridden = F.least(F.lit(1.0), (time - fetch) / (F.lit(0.6) * (finish - fetch)))
    s_lat, s_lng, r_lat, r_lng = (F.col(c) for c in ("s_lat", "s_lng", "r_lat", "r_lng"))
    lat = (
        F.when(time < arrive, s_lat + F.lit(0.004) * (arrive - accept - 30 * step) / (arrive - accept))
        .when(time < fetch, s_lat)
        .otherwise(s_lat + (r_lat - s_lat) * ridden)
    )
    lng = _case(time < fetch, s_lng, s_lng + (r_lng - s_lng) * ridden)
    lost = (order + step) % 211 == 0
    # A trip is shorter than a day, so its positions lie on two days at most: their texts are made once a trip.
    days = {"first_dt": date_of_epoch(accept, ZONE), "last_dt": date_of_epoch(last, ZONE)}
    same_day = F.floor(time / DAY_S) == F.floor(accept / DAY_S)
    return trips.withColumns(days).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - accept) / 30)))
    ).select(
        F.col("transporter_id").alias("user_id"),
        _case(lost, F.lit(0.0), lat).alias("lat"),
        _case(lost, F.lit(0.0), lng).alias("lng"),
        # Some positions were logged days before the date of their partition.
        (time - _case((order + step) % 197 == 0, 5 * DAY_S, 0)).alias("logging_unixtime"),
        _case(same_day, F.col("first_dt"), F.col("last_dt")).alias("log_dt"),
    )


def _address(e: Column) -> Column:
    n = (e % 30 + 1).cast("string")
    return (
        F.when(e % 6 == 0, F.concat(F.lit("望丛路12号"), n, F.lit("楼")))
        .when(e % 6 == 1, "胸科医院3号楼八楼护士站")
        .when(e % 6 == 2, "新港中路352号1803")
        .when(e % 6 == 3, "负一楼")
        .when(e % 6 == 4, F.concat(F.lit("18号楼"), n, F.lit("D")))
        .otherwise("二十三层")
    )


def orders(trips: DataFrame) -> DataFrame:
    e = F.col("event_id")
    too_early = F.when(e % 59 == 0, 6 * DAY_S).when(e % 67 == 0, 8 * DAY_S).otherwise(0)
    return trips.select(
        e.alias("order_id"),
        "transporter_id",
        "supplier_id",
        (F.col("city_id") * 100 + F.col("poi_k")).alias("receiver_id"),
        # No fetch time at all, or one six or eight days too early.
        _case(e % 89 == 0, S.ZERO_DATE, format_epoch(F.col("fetch_u") - too_early, ZONE)).alias("fetch_time"),
        format_epoch(_case(e % 83 == 0, S.UNSET_TIME_EPOCH, F.col("finish_u")), ZONE).alias("finish_time"),
        F.col("r_lat").alias("receiver_lat"),
        F.col("r_lng").alias("receiver_lng"),
        F.col("s_lat").alias("supplier_lat"),
        F.col("s_lng").alias("supplier_lng"),
        _address(e).alias("receiver_address"),
        (e % 5).alias("cargo_type_id"),
        F.col("value").alias("cargo_weight"),
        (F.col("value") * 2).alias("cargo_amt"),
        (e % 3).cast("double").alias("tips_amt"),
        (e % 2).cast("double").alias("allowance_amt"),
        "city_id",
        date_of_epoch(F.col("accept_u"), ZONE).alias("create_dt"),
        _case(e % 41 == 0, 3, 4).alias("order_status"),
        _case(e % 43 == 0, S.EXCLUDED_SOURCE, "app").alias("order_source_from"),
    )


def _shop_type(supplier: Column) -> Column:
    return _case(supplier % 20 == 19, 5, 1)


def deliveries(trips: DataFrame) -> DataFrame:
    """Some ids occur twice, for two couriers; some were fetched before the arrival was reported."""
    e = F.col("event_id")
    fetched = _case(e % 127 == 0, F.col("arrive_u") - 40, F.col("fetch_u"))
    return trips.select(
        _case(e % 109 == 0, e - 1, e).alias("delivery_id"),
        "transporter_id",
        "supplier_id",
        _case(e % 101 == 0, 0.0, (e % 3000 + 500).cast("double")).alias("distance"),
        (e % 5).alias("cargo_type_id"),
        format_epoch(F.col("accept_u"), ZONE).alias("accept_time"),
        _case(e % 89 == 0, S.ZERO_DATE, format_epoch(F.col("arrive_u"), ZONE)).alias("arrive_time"),
        format_epoch(fetched, ZONE).alias("fetch_time"),
        format_epoch(F.col("finish_u"), ZONE).alias("finish_time"),
        "city_id",
        date_of_epoch(F.col("accept_u"), ZONE).alias("create_dt"),
        _case(e % 41 == 0, 3, 4).alias("delivery_status"),
        _shop_type(F.col("supplier_id")).alias("supplier_type_id"),
        _case(e % 43 == 0, S.EXCLUDED_SOURCE, "app").alias("delivery_source_from"),
    )


def suppliers(trips: DataFrame) -> DataFrame:
    """The shops that occur in the trips; a few have no position."""
    s = F.col("supplier_id")
    return trips.select("supplier_id").distinct().select(
        "supplier_id",
        _case(
            s % 33 == 32, 0.0, F.lit(30.0) + (s % 25) * F.lit(0.1) + F.floor(s / 25) * F.lit(0.01)
        ).alias("supplier_lat"),
        (F.lit(120.0) + (s % 25) * F.lit(0.1)).alias("supplier_lng"),
        _shop_type(s).alias("supplier_type_id"),
    )


def poi_info(trips: DataFrame) -> DataFrame:
    """A landmark near each receiver point; two at points 0, one shared by points 4 and 5."""
    city, k = F.col("city_id"), F.col("poi_k")

    def lat(point: Column) -> Column:
        return F.lit(30.0) + city * F.lit(0.1) + point * F.lit(0.01) + F.lit(0.005)

    at = _case(k == 5, F.lit(4).cast("long"), k)
    points = trips.select("city_id", "poi_k").distinct()
    first = F.struct(
        F.concat(F.lit("p"), city, F.lit("_"), at).alias("poi_id"),
        (k + 10).cast("double").alias("distance"),
        (lat(at) + F.lit(0.0003)).alias("poi_lat"),
    )
    second = F.struct(
        F.concat(F.lit("q"), city, F.lit("_"), at).alias("poi_id"),
        F.lit(25.0).alias("distance"),
        (lat(at) - F.lit(0.0003)).alias("poi_lat"),
    )
    return points.withColumn(
        "poi", F.explode(_case(k == 0, F.array(first, second), F.array(first)))
    ).select(
        (F.lit(120.0) + city * F.lit(0.1) + F.lit(0.008)).alias("lng"),
        lat(k).alias("lat"),
        "poi.poi_id",
        F.when(k != 7, F.concat(F.lit("landmark "), k)).alias("poi_name"),
        "poi.distance",
        "poi.poi_lat",
        (F.lit(120.0) + city * F.lit(0.1) + F.lit(0.008)).alias("poi_lng"),
        _case(k == 6, "street", S.LANDMARK_TYPE).alias("poi_type"),
    )


def poi_difficulty(trips: DataFrame) -> DataFrame:
    city, k = F.col("city_id"), F.col("poi_k")
    return (
        trips.select("city_id", "poi_k")
        .distinct()
        .where(k.isin(1, 2))
        .select(
            F.concat(F.lit("p"), city, F.lit("_"), k).alias("poi_id"),
            F.when(city % 5 != 0, k.cast("int")).alias("difficulty"),
        )
    )


def biz_log(trips: DataFrame) -> DataFrame:
    """Three JSON rows per trip: pick-up prediction, hand-over prediction, probability."""
    e = F.col("event_id")

    def text(template: str, *values) -> Column:
        return F.format_string(template, *values)

    common = (
        '{"recOrderId":"r%d","orderId":"%d","isDowngrade":"%d","test_id":"%s","cityId":"%d",'
        '"transporterId":"%d","supplierLat":"30.%d","now_timestamp":"%d","%s":"%s"}'
    )
    group = F.when(e % 3 == 0, "blank").when(e % 3 == 1, "new").otherwise("other")

    def prediction(field: str, seconds: Column) -> Column:
        value = _case(e % 53 == 0, "n/a", seconds.cast("string"))
        return text(
            common, e, e, e % 2, group, F.col("city_id"), F.col("transporter_id"),
            F.col("city_id"), F.col("accept_u"), F.lit(field), value,
        )

    probability = text(
        '{"order_id":"%d","prob":"0.%d","dynamic_info":{"time_window_key":"w%d","overtime_allowance":%d,'
        '"tips":%d,"allowance":%d}}',
        e, e % 90 + 10, e % 4, e % 6, e % 3, e % 2,
    )
    kinds = F.array(
        F.struct(
            F.lit(S.LOG_TYPE_PICKUP).alias("biz_type"),
            prediction("pickupTimeValue", F.col("arrive_u") - F.col("accept_u") + e % 120).alias("data"),
        ),
        F.struct(
            F.lit(S.LOG_TYPE_RECEIVER).alias("biz_type"),
            prediction("receiverTimeValue", e % 200 + 100).alias("data"),
        ),
        F.struct(F.lit(S.LOG_TYPE_PROBABILITY).alias("biz_type"), probability.alias("data")),
    )
    return trips.select(
        date_of_epoch(F.col("accept_u"), ZONE).alias("dt"), F.inline(kinds)
    )


def rating_lines(trips: DataFrame) -> DataFrame:
    """Courier-rating samples as text lines in all three delimiters, some with missing words."""
    e = F.col("event_id")
    fields = [
        F.col("transporter_id").cast("string"),
        _case(e % 37 == 0, "NULL", ((e * 17) % 2500).cast("string")),
        (e % 5 + 1).cast("string"),
        (e % 30 + 1).cast("string"),
        ((e * 13) % 16000 + 300).cast("string"),
        (F.col("event_id") % 8 * F.lit(0.5)).cast("string"),
        _case(e % 29 == 0, "None", (e % 3).cast("string")),
        (e % 2).cast("string"),
        F.when(e % 61 == 0, "yes").when(e % 7 == 0, "1").otherwise("0"),
    ]
    return trips.select(
        F.when(e % 71 == 0, "  ")
        .when(e % 3 == 0, F.concat_ws("\t", *fields))
        .when(e % 3 == 1, F.concat_ws(",", *fields))
        .otherwise(F.concat(F.lit(" "), F.concat_ws("  ", *fields)))
        .alias("value")
    )


def scored(trips: DataFrame) -> DataFrame:
    """A class per trip and a score that leans towards it, with many equal scores."""
    e = F.col("event_id")
    positive = e % 7 == 0
    raw = (e * 7919 + _case(positive, 400, 0)) % 997
    return trips.select(
        e.alias("order_id"),
        _case(positive, 1, -1).alias("label"),
        (raw / F.lit(997.0)).alias("score"),
    )


class DerivedWarehouse:
    """The input tables of the jobs, each derived when it is first asked for."""

    _tables = {
        "orders": orders,
        "deliveries": deliveries,
        "coords": coords,
        "suppliers": suppliers,
        "poi_info": poi_info,
        "poi_difficulty": poi_difficulty,
        "biz_log": biz_log,
    }

    def __init__(self, base: DataFrame):
        self._base = base

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name](self._base)
        setattr(self, name, table)
        return table


_PREPARED: dict[tuple[str, str], dict[str, DataFrame]] = {}
_DATES_OF = {"orders": "create_dt", "deliveries": "create_dt", "coords": "log_dt", "biz_log": "dt"}


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write the derived tables once, by date where a job reads a range; later queries read them."""
    base = trips(spark, sf_dir)
    stored = {"trips": staged(base, "trips")}
    wh = DerivedWarehouse(stored["trips"])
    for name in DerivedWarehouse._tables:
        table = getattr(wh, name)
        date = _DATES_OF.get(name)
        stored[name] = staged(table.repartition(date) if date else table, f"bench-{name}", date)
    _PREPARED[spark.sparkContext.applicationId, sf_dir] = stored


def warehouse(spark: SparkSession, sf_dir: str) -> DerivedWarehouse:
    wh = DerivedWarehouse(trips(spark, sf_dir))
    for name, table in _PREPARED.get((spark.sparkContext.applicationId, sf_dir), {}).items():
        setattr(wh, name, table)
    return wh
