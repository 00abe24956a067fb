"""Parameters of the jobs and the fixed values they share."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DateRange:
    """Inclusive range of `yyyy-MM-dd` partition dates."""

    first: str
    last: str


@dataclass(frozen=True)
class DwellRules:
    """How a stay inside the receiver's circle is measured and filtered (hand-over phase)."""

    circle_m: float = 80.0
    slack_s: int = 120  # positions count until this long after the finish time
    overdwell_s: int = 800  # orders that entered the circle earlier than this are removed
    leaves_after_finish: bool = True  # keep only stays of >1 point with 0 < time1 < time2
    bind_on: str = "delivery_time2"  # which stay must be long enough to bind a landmark ...
    bind_min_s: int = 30  # ... and how long
    bind_min_points: int = 2
    stats_on: str = "delivery_time2"  # which stay the landmark statistics describe
    peak_on: str = "delivery_time2"  # which stay the per-class courier statistics describe
    peak_median: bool = False  # exact median per class instead of the integer mean
    poi_min_orders: int = 5
    drop_sentinel_times: bool = True


CURRENT = DwellRules()

# First generation: stays end at the finish time, every stay is kept, statistics describe time1.
FIRST_GENERATION = DwellRules(
    slack_s=0,
    leaves_after_finish=False,
    bind_on="delivery_time1",
    bind_min_s=15,
    stats_on="delivery_time1",
    peak_on="delivery_time1",
    peak_median=True,
)

# The daily online check does not remove sentinel times.
ONLINE_CHECK = DwellRules(drop_sentinel_times=False)


@dataclass(frozen=True)
class PickupRules:
    """Plausibility limits of the accept-to-fetch phase."""

    max_a1_s: int = 1000
    max_a2_s: int = 1200
    max_distance_m: float = 5000.0
    max_speed_m_s: int = 6
    min_distance_m: float = 0.0


PICKUP = PickupRules()

SHORT_DISTANCE_M = 200

# --- fixed values -----------------------------------------------------------------------------
COMPLETED = 4  # order and delivery status
CONSUMER_SHOP_TYPE = 5  # private senders, left out of the pick-up phase
EXCLUDED_SOURCE = "jdMall"
LANDMARK_TYPE = "landmark_l2"
ZERO_DATE = "0000-00-00 00:00:00"
ZERO_DATE_EPOCH = -62170185600  # what the warehouse reads ZERO_DATE as
UNSET_TIME_EPOCH = 1548950400  # 2019-02-01 00:00 in the warehouse zone: "not set"
HISTORY_MIN_EPOCH = 1556621020
WAREHOUSE_ZONE = "Asia/Shanghai"
LOG_TYPE_PICKUP = 10604
LOG_TYPE_RECEIVER = 10610
LOG_TYPE_PROBABILITY = 10564

DEFAULT_SPEED_M_S = 4.5

# Mean courier speed in m/s by city.
CITY_SPEED_M_S = {
    0: 4.5,
    1: 4.670976602114164,
    2: 4.817198349879338,
    3: 4.800101683689998,
    4: 4.544530281653771,
    5: 4.9441774258246785,
    6: 4.165272254210252,
    7: 4.799496577336238,
    8: 4.8642904208256645,
    9: 4.650193526194646,
    10: 3.8875846679394064,
    11: 3.7497491469750037,
    12: 4.639689977352436,
    13: 4.459546125852144,
    14: 4.416226698802068,
    15: 4.6933662707989035,
    16: 4.3487566984616794,
    17: 4.409211415510911,
    18: 4.839935651192298,
    19: 5.089973101249108,
    21: 5.016223577352671,
    22: 4.828889865141648,
    23: 4.560015036509587,
    24: 4.480501706783588,
    25: 4.837992099615244,
    26: 4.679076176423293,
    28: 4.924391784667969,
    29: 4.4657377279721775,
    30: 4.456049809089074,
    31: 5.324681043624878,
    32: 5.011953353881836,
    35: 5.349959538533137,
    37: 4.849944591522217,
    38: 3.9762484385417056,
    39: 4.0739441101367655,
    76: 4.2549366198088,
    77: 4.153659022771395,
    135: 4.220209901983088,
    180: 4.808286813589243,
}

# Lower and upper bound of each scaled feature.
SCALE_BOUNDS = {
    "score": (0.0, 2000.0),
    "avg_dis": (500.0, 15000.0),
    "avg_speed": (0.5, 4.0),
    "invalid_cnt": (0.0, 10.0),
    "work_dt_cnt": (1.0, 30.0),
    "score/avg_speed": (0.0, 1000.0),
    "grade/avg_speed": (0.0, 5.0),
    "work_dt_cnt*avg_dis": (1.0, 100.0),
}
