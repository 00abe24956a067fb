"""Hand-over phase: courier positions inside the receiver's circle and the stay they measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorclock.functions import geo
from doorclock.functions.times import format_epoch
from doorclock.settings import CURRENT, WAREHOUSE_ZONE, DwellRules

# A window is covered by the hours it touches or, beyond so many of them, by one block of all time.
HOUR_S = 3600
MOST_HOURS = 8
ALL_TIME = -(2**62)

# What a stay is grouped by: the order and everything that is constant for it.
ORDER_ATTRIBUTES = [
    "order_id",
    "receiver_id",
    "supplier_id",
    "transporter_id",
    "r_lng",
    "r_lat",
    "s_r_line_distance",
    "finish_time",
    "finish_time_unix",
    "city_id",
    "receiver_address",
    "cargo_type_id",
    "cargo_weight",
]


def _hour(time: Column) -> Column:
    return F.floor(time / HOUR_S)


def _row_key() -> Column:
    """Tells orders apart that share an id."""
    return F.xxhash64(*ORDER_ATTRIBUTES)


def _place(*keys: Column) -> Column:
    """One number for a courier, an hour and a cell."""
    return F.xxhash64(*keys)


def _equal(a: str, b: str) -> Column:
    """Equality that is tested on rows of one place, and not made a join key of its own."""
    return F.col(a).between(F.col(b), F.col(b))


def pings_in_circle(orders: DataFrame, pings: DataFrame, rules: DwellRules = CURRENT) -> DataFrame:
    """Every position of the order's courier within the circle between fetch and finish + slack.

    Rows are narrow: (order_id, order_row, t_lat, t_lng, report_unixtime); `with_orders` adds the
    order's columns, `stays` only after it has aggregated.

    Courier, hour and grid cell together form the equi-join key, as one number: rows are sorted by a single
    long, and what it stands for is compared where numbers meet. A position has one hour and one cell; an
    order is repeated for the few hours and cells that its window and circle touch. One courier with very
    many rows therefore spreads over many keys, and the pairs tested are those close in time and place. A
    long window (an order without a real fetch time) is repeated for those hours only in which its courier
    was in the cell, however long it is, and finds positions whenever they were logged.
    """
    until = F.col("finish_time_unix") + rules.slack_s
    first, last = _hour(F.col("fetch_time_unix")), _hour(until)
    # Numbers of different types have different hashes, texts have not.
    same = orders.schema["transporter_id"].dataType == pings.schema["user_id"].dataType
    courier, user = (F.col(c) if same else F.col(c).cast("string") for c in ("transporter_id", "user_id"))
    positions = pings.select(
        F.col("user_id"),
        F.col("lat").alias("t_lat"),
        F.col("lng").alias("t_lng"),
        F.col("log_time").alias("report_unixtime"),
        geo.lat_cell(F.col("lat")).alias("_p_lat_cell"),
        geo.lng_cell(F.col("lng")).alias("_p_lng_cell"),
        _hour(F.col("log_time")).alias("_p_block"),
    )
    blocks = F.when(last - first >= MOST_HOURS, F.array(F.lit(ALL_TIME))).otherwise(F.sequence(first, last))
    probes = (
        orders.where(F.col("fetch_time_unix") <= until)
        .select(
            "order_id", _row_key().alias("order_row"), "transporter_id", "r_lat", "r_lng",
            "fetch_time_unix", until.alias("_until"), F.explode(blocks).alias("_block"),
        )
        .withColumn("_lat_cell", F.explode(geo.lat_cells_within(F.col("r_lat"), rules.circle_m)))
        .withColumn(
            "_lng_cell",
            F.explode(geo.lng_cells_within(F.col("r_lng"), F.col("r_lat"), rules.circle_m)),
        )
    )
    # All time stands for the hours in which the courier was in the cell; other blocks stay as they are.
    there = positions.select(
        F.col("user_id").alias("_user"), F.col("_p_lat_cell").alias("_at_lat"), F.col("_p_lng_cell").alias("_at_lng"),
        F.col("_p_block").alias("_hour"), F.when(F.col("_p_block").isNotNull(), ALL_TIME).alias("_all"),
    ).distinct()
    was_there = (
        (F.col("transporter_id") == F.col("_user"))
        & (F.col("_block") == F.col("_all"))
        & (F.col("_lat_cell") == F.col("_at_lat"))
        & (F.col("_lng_cell") == F.col("_at_lng"))
        & F.col("_hour").between(_hour(F.col("fetch_time_unix")), _hour(F.col("_until")))
    )
    probes = probes.join(there.hint("merge"), was_there, "left").select(
        "order_id", "order_row", "transporter_id", "r_lat", "r_lng", "fetch_time_unix", "_until",
        F.coalesce("_hour", "_block").alias("_block"), "_lat_cell", "_lng_cell",
    )
    probes = probes.withColumn("_place", _place(courier, F.col("_block"), F.col("_lat_cell"), F.col("_lng_cell")))
    placed = positions.withColumn("_p_place", _place(user, F.col("_p_block"), F.col("_p_lat_cell"), F.col("_p_lng_cell")))
    inside = (
        (F.col("_place") == F.col("_p_place"))
        & _equal("transporter_id", "user_id")
        & _equal("_block", "_p_block")
        & _equal("_lat_cell", "_p_lat_cell")
        & _equal("_lng_cell", "_p_lng_cell")
        & (F.col("report_unixtime") > F.col("fetch_time_unix"))
        & (F.col("report_unixtime") <= F.col("_until"))
        & geo.near(F.col("r_lat"), F.col("t_lat"), rules.circle_m)
        & (
            geo.distance_m(F.col("r_lng"), F.col("r_lat"), F.col("t_lng"), F.col("t_lat"))
            < rules.circle_m
        )
    )
    # Both sides grow with the data, and neither's size is known before it is repeated or derived,
    # so neither may be broadcast on an estimate: sort-merge, which spills and can be split.
    return placed.join(probes.hint("merge"), inside).select(
        "order_id", "order_row", "t_lat", "t_lng", "report_unixtime"
    )


def _keyed(orders: DataFrame) -> DataFrame:
    """Orders once each; equal order rows have doubled their positions already."""
    return orders.withColumn("order_row", _row_key()).dropDuplicates(["order_id", "order_row"])


def with_orders(in_circle: DataFrame, orders: DataFrame) -> DataFrame:
    """Positions with all columns of their order."""
    return in_circle.join(_keyed(orders), ["order_id", "order_row"]).select(
        *orders.columns, "t_lat", "t_lng", "report_unixtime"
    )


def ranked_pings(in_circle: DataFrame, zone: str = WAREHOUSE_ZONE) -> DataFrame:
    """Number the positions of each order by time; 1 is the entry into the circle."""
    by_time = Window.partitionBy("order_id").orderBy("report_unixtime", "t_lat", "t_lng")
    return in_circle.withColumns(
        {
            "report_time": format_epoch(F.col("report_unixtime"), zone),
            "row_num": F.row_number().over(by_time).cast("long"),
        }
    )


def overdwell_orders(ranked: DataFrame, rules: DwellRules = CURRENT) -> DataFrame:
    """Entry rows of orders whose courier stayed in the circle too long before finishing."""
    return ranked.where(
        (F.col("row_num") == 1)
        & (F.col("report_unixtime") < F.col("finish_time_unix") - rules.overdwell_s)
    )


def without_orders(pings: DataFrame, rejected: DataFrame) -> DataFrame:
    """Positions of the orders that are not in `rejected`."""
    key = ["order_id", "transporter_id", "receiver_id"]
    return pings.join(rejected.select(*key), key, "left_anti").select(*pings.columns)


def without_overdwell(ranked: DataFrame, rules: DwellRules = CURRENT) -> DataFrame:
    """As `without_orders` with `overdwell_orders`: each order's first position is read along in the order of ranking."""
    by_time = Window.partitionBy("order_id").orderBy("report_unixtime", "t_lat", "t_lng")
    key = F.struct("transporter_id", "receiver_id")
    late = F.col("report_unixtime") < F.col("finish_time_unix") - rules.overdwell_s
    rejected = F.first(F.when(late, key)).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        ranked.withColumn("_rejected", rejected)
        .where(~F.coalesce((F.col("_rejected.transporter_id") == F.col("transporter_id")) & (F.col("_rejected.receiver_id") == F.col("receiver_id")), F.lit(False)))
        .drop("_rejected")
    )


def stays(in_circle: DataFrame, orders: DataFrame, *also: str) -> DataFrame:
    """One row per order: seconds from entry to finish, entry to last position, positions, and `also` of the order."""
    totals = in_circle.groupBy("order_id", "order_row").agg(
        F.min("report_unixtime").alias("_entry"),
        F.max("report_unixtime").alias("_last"),
        F.count(F.lit(1)).alias("point_cnt"),
    )
    return totals.join(_keyed(orders.select(*ORDER_ATTRIBUTES, *also)), ["order_id", "order_row"]).select(
        *ORDER_ATTRIBUTES,
        *also,
        (F.col("finish_time_unix") - F.col("_entry")).alias("delivery_time1"),
        (F.col("_last") - F.col("_entry")).alias("delivery_time2"),
        "point_cnt",
    )


def not_overdwell(rules: DwellRules = CURRENT) -> Column:
    """True for stays of orders that `overdwell_orders` would not name.

    The entry is the earliest position of the order, so the test reads the stay itself and needs
    neither the ranked positions nor an anti-join. Order ids are unique in the order table.
    """
    return F.col("delivery_time1") <= rules.overdwell_s


def valid_stay(rules: DwellRules = CURRENT) -> Column:
    if not rules.leaves_after_finish:
        return F.lit(True)
    return (
        (F.col("point_cnt") > 1)
        & (F.col("delivery_time1") > 0)
        & (F.col("delivery_time2") > F.col("delivery_time1"))
    )


def dwell(in_circle: DataFrame, orders: DataFrame, rules: DwellRules = CURRENT, *also: str) -> DataFrame:
    """Stays that count: no over-dwell, and valid by the generation's rule."""
    return (
        stays(in_circle, orders, *also)
        .where(not_overdwell(rules) & valid_stay(rules))
        .drop("finish_time_unix")
    )
