"""Distances, grid cells, geohash and rounded-point keys as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180.0
CELL_DEGREES = 0.01
_CELLS_ROUND = 36000  # cells once round the globe

# Geohash base-32 alphabet (fixed by the format).
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def distance_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle (haversine) distance in metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (
        F.sin(half_lng) * F.sin(half_lng)
    )
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def _lat_reach(radius_m: float) -> float:
    """Degrees of latitude a circle spans to each side, with a margin for rounding."""
    return radius_m / METRES_PER_DEGREE * 1.0001


def _lng_reach(lat: Column, radius_m: float) -> Column:
    """Upper bound of the degrees of longitude a circle spans to each side."""
    reach = _lat_reach(radius_m)
    nearest_pole = F.least(F.abs(lat) + reach, F.lit(89.9999))
    return F.least(F.lit(reach) / F.cos(F.radians(nearest_pole)), F.lit(180.0))


def near(lat: Column, other_lat: Column, radius_m: float) -> Column:
    """Cheap test that every pair closer than the radius passes."""
    return F.abs(lat - other_lat) <= _lat_reach(radius_m)


def _cell(degrees: Column) -> Column:
    return F.floor(degrees / CELL_DEGREES)


def lat_cell(lat: Column) -> Column:
    return _cell(lat)


def lng_cell(lng: Column) -> Column:
    return F.pmod(_cell(lng), F.lit(_CELLS_ROUND).cast("long"))


def lat_cells_within(lat: Column, radius_m: float) -> Column:
    """All latitude cells a circle touches."""
    reach = _lat_reach(radius_m)
    return F.sequence(_cell(lat - reach), _cell(lat + reach))


def lng_cells_within(lng: Column, lat: Column, radius_m: float) -> Column:
    """All longitude cells a circle touches, wrapped at the date line."""
    reach = _lng_reach(lat, radius_m)
    cells = F.sequence(_cell(lng - reach), _cell(lng + reach))
    return F.array_distinct(
        F.transform(cells, lambda c: F.pmod(c, F.lit(_CELLS_ROUND).cast("long")))
    )


def point_key(degrees: Column) -> Column:
    """A coordinate rounded to five decimals, as a whole number that compares exactly."""
    return F.round(degrees * 100000).cast("long")


def _woven(first: int, second: int, width: int) -> int:
    """The bits of both numbers in turn, beginning with the first one's highest."""
    bits = [((first, second)[i % 2] >> ((width - 1 - i) // 2)) & 1 for i in range(width)]
    return int("".join(map(str, bits)), 2)


# A letter holds five bits. Where longitude comes first it is woven from three longitude and two
# latitude bits, in every other letter from three latitude and two longitude bits; in both cases a
# table is indexed by the three bits followed by the two.
_LETTERS = "".join(
    GEOHASH_ALPHABET[_woven(three, two, 5)] for three in range(8) for two in range(4)
)


def geohash7(lng: Column, lat: Column) -> Column:
    """Seven-character geohash: 18 longitude and 17 latitude bits, interleaved."""

    def steps(value: Column, low: float, width: float, bits: int) -> Column:
        index = F.floor((value - low) / width * float(2**bits))
        return F.greatest(F.least(index, F.lit(2**bits - 1)), F.lit(0)).cast("int")

    halves = {"x": (steps(lng, -180.0, 360.0, 18), 18), "y": (steps(lat, -90.0, 180.0, 17), 17)}
    used = {"x": 0, "y": 0}

    def take(axis: str, count: int) -> Column:
        value, bits = halves[axis]
        used[axis] += count
        return F.shiftright(value, bits - used[axis]).bitwiseAND(F.lit(2**count - 1))

    letters = []
    for i in range(7):
        leading, other = ("x", "y") if i % 2 == 0 else ("y", "x")
        index = take(leading, 3) * 4 + take(other, 2)
        letters.append(F.substr(F.lit(_LETTERS), index + 1, F.lit(1)))
    return F.concat(*letters)
