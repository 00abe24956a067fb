"""The input tables of the jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Warehouse:
    orders: DataFrame
    deliveries: DataFrame
    coords: DataFrame
    suppliers: DataFrame
    poi_info: DataFrame
    poi_difficulty: DataFrame
    biz_log: DataFrame
