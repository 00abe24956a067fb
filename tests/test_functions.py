import re

import pytest
from pyspark.sql import functions as F

from doorclock import settings as S
from doorclock.functions import geo, scaling, text, times


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_peak_classes_cover_every_hour(spark):
    got = dict(values(spark, [(h,) for h in range(24)], "h int", "h", times.peak_class(F.col("h"))))
    expected = {h: 0 for h in range(24)}
    expected.update({h: 1 for h in (11, 12, 18, 19)})
    expected.update({h: 2 for h in (9, 10, 15, 16, 20, 21)})
    expected.update({h: 3 for h in (0, 1, 2, 3, 4, 5, 6, 7, 8, 23)})
    assert got == expected
    assert [got[h] for h in (13, 14, 17, 22)] == [0, 0, 0, 0]


def test_wall_clock_is_read_in_the_given_zone_only(spark):
    rows = [("2019-02-01 00:00:00",), (S.ZERO_DATE,), ("2019-02-30 00:00:00",), ("2019-02-01",), (None,)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session_zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            t = F.col("t")
            got = values(spark, rows, "t string", times.parse_epoch(t), times.parse_epoch(t, "UTC"))
            assert got[0] == (S.UNSET_TIME_EPOCH, S.UNSET_TIME_EPOCH + 8 * 3600)
            assert got[1] == (S.ZERO_DATE_EPOCH, S.ZERO_DATE_EPOCH)
            assert got[2:] == [(None, None)] * 3
            back = values(spark, [(S.UNSET_TIME_EPOCH,)], "u long", times.format_epoch(F.col("u")))
            assert back == [("2019-02-01 00:00:00",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_dates(spark):
    got = values(spark, [("2024-03-01",)], "d string", times.days_before(F.col("d"), 1), times.compact_date(F.col("d"), 1))
    assert got == [("2024-02-29", "20240229")]


def test_distance_and_geohash(spark):
    got = values(
        spark,
        [(10.40744, 57.64911)],
        "lng double, lat double",
        geo.geohash7(F.col("lng"), F.col("lat")),
        geo.distance_m(F.col("lng"), F.col("lat"), F.col("lng"), F.col("lat") + 1),
    )
    assert got[0][0] == "u4pruyd"
    assert got[0][1] == pytest.approx(geo.METRES_PER_DEGREE, rel=1e-9)


def test_geohash_agrees_with_bisection(spark):
    def bisected(lng, lat):
        spans, bits = {"x": [-180.0, 180.0], "y": [-90.0, 90.0]}, []
        for i in range(35):
            axis, value = ("x", lng) if i % 2 == 0 else ("y", lat)
            low, high = spans[axis]
            middle = (low + high) / 2
            bits.append(int(value >= middle))
            spans[axis] = [middle, high] if value >= middle else [low, middle]
        return "".join(
            geo.GEOHASH_ALPHABET[int("".join(map(str, bits[k : k + 5])), 2)] for k in range(0, 35, 5)
        )

    points = [(-179.9, -89.9), (179.9, 89.9), (0.0, 0.0), (120.123, 30.456), (-0.0001, 0.0001), (-73.98, 40.75)]
    got = values(spark, points, "lng double, lat double", geo.geohash7(F.col("lng"), F.col("lat")))
    assert [g for (g,) in got] == [bisected(*p) for p in points]


NUMERALS = {"一": 1, "十": 10, "十五": 15, "二十": 20, "二十三": 23, "九十九": 99, "一二三": 6, "十二十": 30}


def test_numerals(spark):
    got = values(spark, [(k,) for k in NUMERALS], "s string", "s", text.numeral_value(F.col("s")))
    assert dict(got) == NUMERALS


ADDRESSES = {
    "淮海西路241路近番禺路胸科医院3号楼八楼护士站十五楼": (8, 3),
    "会展时代丽影广场新港中路352号1803": (18, -999),
    "胸科医院3号楼护士站": (0, 3),
    "前进路与颖河路交叉口东南角负一楼": (-1, -999),
    "望丛中路1092号-1F": (-1, -999),
    "望丛中路13号楼43D": (43, 13),
    "望丛中路十八号楼43D": (43, 18),
    "万源路2289弄2号18039": (80, -999),
    "小区 (6号302室（门铃按804）)": (3, -999),
    "10号楼4023": (40, 10),
    "住院楼13楼19床": (13, -999),
    "B2层": (-2, -999),
    "": (0, -999),
}


def test_addresses(spark):
    a = F.col("a")
    got = values(
        spark, [(k,) for k in ADDRESSES], "a string", "a", text.address_floor(a), text.address_building(a)
    )
    assert {k: (f, b) for k, f, b in got} == ADDRESSES


def test_plain_floor_pattern_takes_no_other_letters(spark):
    got = values(spark, [("43D",), ("12F",)], "a string", text.address_floor(F.col("a"), text.FLOOR_PATTERN_PLAIN))
    assert got == [(0,), (12,)]


def test_null_words_and_fields(spark):
    lines = ["a\tNULL\tb c", "a,Null,None", " x  y  z "]
    line = text.stripped(F.col("v"))
    got = values(spark, [(x,) for x in lines], "v string", text.split_fields(text.mask_null_words(line)))
    assert [g for (g,) in got] == [["a", "-1", "b c"], ["a", "-1", "-1"], ["x", "y", "z"]]


def test_scaling_and_label(spark):
    v = F.col("v")
    got = values(
        spark, [(0.0,), (1000.0,), (4000.0,), (-100.0,)], "v double",
        scaling.scaled("score", v), F.round(scaling.expand(scaling.compress(F.abs(v))), 6), scaling.whole(v.cast("string")),
    )
    assert got == [(0.0, 0.0, 0), (0.5, 1000.0, 1000), (1.0, 4000.0, 4000), (-0.05, 100.0, -100)]
    cut = values(spark, [("3.7",), ("-3.7",), ("x",)], "v string", scaling.whole(v))
    assert cut == [(3,), (-3,), (None,)]


def test_json_fields(spark):
    rows = [('{"a":{"b":"3"},"c":1}',), ("no json",)]
    got = values(spark, rows, "d string", text.json_field(F.col("d"), "a", "b"), text.json_field(F.col("d"), "c"))
    assert got == [("3", "1"), (None, None)]


def test_cells_of_a_circle_hold_every_point_in_it(spark):
    import random

    rng = random.Random(4)
    centres = [(179.9999, 0.0), (-180.0, 60.0), (0.0, 0.0), (120.01, 30.0), (10.0, 85.0)]
    rows = [
        (lng, lat, lng + rng.uniform(-1, 1) * 0.0008 / max(0.05, abs(__import__("math").cos(lat * 3.14159 / 180))), lat + rng.uniform(-1, 1) * 0.0008)
        for lng, lat in centres
        for _ in range(200)
    ]
    lng, lat, x, y = (F.col(c) for c in ("lng", "lat", "x", "y"))
    df = spark.createDataFrame(rows, "lng double, lat double, x double, y double")
    inside = df.where(geo.distance_m(lng, lat, x, y) < 80)
    assert inside.count() > 200
    missed = inside.where(
        ~F.array_contains(geo.lat_cells_within(lat, 80.0), geo.lat_cell(y))
        | ~F.array_contains(geo.lng_cells_within(lng, lat, 80.0), geo.lng_cell(x))
        | ~geo.near(lat, y, 80.0)
    )
    assert missed.count() == 0


def test_patterns_are_valid_for_both_engines():
    for pattern in (text.BASEMENT_PATTERN, text.FLOOR_PATTERN, text.BUILDING_PATTERN):
        re.compile(pattern)
