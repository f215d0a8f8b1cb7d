"""Distances and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEGREE = math.pi * EARTH_M / 180


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M1. Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """F9. Within a box, bounds included."""
    return lat.between(south, north) & lon.between(west, east)


def grid_points(spark: SparkSession, south: float, west: float, north: float, east: float, n: int) -> DataFrame:
    """M2. The centres of ``n`` times ``n`` cells of a box: (row, col, lat, lon)."""
    cells = spark.range(n * n).select((F.expr(f"id div {n}")).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    return cells.select("row", "col", (south + (F.col("row") + 0.5) * ((north - south) / n)).alias("lat"), (west + (F.col("col") + 0.5) * ((east - west) / n)).alias("lon"))


def cell_of(lat: Column, lon: Column, south: float, west: float, north: float, east: float, n: int) -> tuple[Column, Column]:
    """M2. (row, col) of a point in the grid of a box."""
    row = F.floor((lat - south) / ((north - south) / n)).cast("int")
    col = F.floor((lon - west) / ((east - west) / n)).cast("int")
    return F.least(row, F.lit(n - 1)), F.least(col, F.lit(n - 1))
