"""Column lists of the sample files and layouts of the published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the pick-up sample, in file order.
PICKUP_SAMPLE = [
    "delivery_id",
    "transporter_id",
    "supplier_id",
    "supplier_type_id",
    "distance",
    "cargo_type_id",
    "accept_time",
    "arrive_time",
    "fetch_time",
    "finish_time",
    "a_time",
    "a1_time",
    "a2_time",
    "report_time",
    "row_num",
    "supp_lat",
    "supp_lng",
    "lat",
    "lng",
    "real_time_line_distance",
    "city_id",
    "s_geohash",
    "t_geohash",
    "t_history_order_num",
    "t_avg_a1_time",
    "t_avg_a2_time",
    "s_history_order_num",
    "s_avg_a1_time",
    "s_avg_a2_time",
    "cargo_weight",
]

# Columns of the hand-over sample, in file order.
HANDOVER_SAMPLE = [
    "order_id",
    "supplier_id",
    "transporter_id",
    "receiver_id",
    "s_r_line_distance",
    "finish_time",
    "receiver_address",
    "cargo_type_id",
    "cargo_weight",
    "r_lng",
    "r_lat",
    "poi_id",
    "poi_lat",
    "poi_lng",
    "is_hard_poi",
    "difficulty",
    "receiver_poi_distance",
    "percentile_delivery_time_poi",
    "avg_delivery_time_poi",
    "percentile_distance_poi",
    "std_distance_poi",
    "std_delivery_time_poi",
    "order_cnt",
    "city_id",
    "delivery_time1",
    "delivery_time2",
    "error1",
    "error2",
    "t_history_order_num",
    "t_avg_a1_time",
    "t_avg_a2_time",
    "delivery_cnt",
    "avg_delivery_time2",
    "per_delivery_time2",
    "cnt_peek1",
    "cnt_peek2",
    "cnt_peek3",
    "cnt_peek0",
    "per_delivery_time_peek1",
    "per_delivery_time_peek2",
    "per_delivery_time_peek3",
    "per_delivery_time_peek0",
]

# Columns of the courier-rating sample, in file order.
RATING_SAMPLE = [
    "transporter_id",
    "score",
    "grade",
    "work_dt_cnt",
    "avg_dis",
    "avg_speed",
    "invalid_cnt",
    "not_first_invalid",
    "invalid_label",
]

# Published tables: columns in order with type and default, and the unique key. Coordinates stay
# double, because landmark statistics are looked up by equal coordinates.
POI_STATISTICS = {
    "id": ("bigint", None),
    "poi_id": ("string", "0"),
    "percentile_delivery_time_poi": ("double", 0),
    "avg_delivery_time_poi": ("double", 0),
    "percentile_distance_poi": ("double", 0),
    "std_distance_poi": ("double", 0),
    "std_delivery_time_poi": ("double", 0),
    "order_cnt": ("int", 0),
    "city_id": ("int", 0),
    "poi_lat": ("double", 0),
    "poi_lng": ("double", 0),
    "create_time": ("string", None),
    "update_time": ("string", None),
}
POI_STATISTICS_KEY = ["poi_id", "city_id", "poi_lat", "poi_lng"]


def _history(owner: str) -> dict:
    return {
        "id": ("bigint", None),
        owner: ("bigint", -1),
        "history_order_num": ("double", 0),
        "avg_a1_time": ("double", 0),
        "avg_a2_time": ("double", 0),
        "city_id": ("int", 0),
        "create_time": ("string", None),
        "update_time": ("string", None),
    }


SUPPLIER_HISTORY = _history("supplier_id")
SUPPLIER_HISTORY_KEY = ["supplier_id"]
COURIER_HISTORY = _history("transporter_id")
COURIER_HISTORY_KEY = ["transporter_id"]

_PEAK_COUNTS = ["cnt_peek1", "cnt_peek2", "cnt_peek3", "cnt_peek0"]
_PEAK_TIME1 = [f"per_delivery_time1_peek{c}" for c in (1, 2, 3, 0)]
_PEAK_TIME2 = [f"per_delivery_time_peek{c}" for c in (1, 2, 3, 0)]
COURIER_PEAK = {
    "id": ("bigint", None),
    "transporter_id": ("bigint", -1),
    "city_id": ("int", 0),
    "delivery_cnt": ("int", -1),
    "avg_delivery_time1": ("int", -1),
    "avg_delivery_time2": ("int", -1),
    "per_delivery_time1": ("int", -1),
    "per_delivery_time2": ("int", -1),
    **{name: ("int", -1) for name in _PEAK_COUNTS + _PEAK_TIME1 + _PEAK_TIME2},
    "create_time": ("string", None),
    "update_time": ("string", None),
}
COURIER_PEAK_KEY = ["transporter_id", "city_id"]


def conformed(df: DataFrame, layout: dict) -> DataFrame:
    """Project to a published layout: missing columns and nulls take the layout's default."""

    def column(name: str, kind: str, default: object) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None)
        value = value.cast(kind)
        return value if default is None else F.coalesce(value, F.lit(default).cast(kind))

    return df.select(*[column(n, k, d).alias(n) for n, (k, d) in layout.items()])


def modern_names(df: DataFrame) -> DataFrame:
    """Rename the older `deliver_time*` columns."""
    return df.withColumnsRenamed(
        {c: c.replace("deliver_time", "delivery_time") for c in df.columns if "deliver_time" in c}
    )
