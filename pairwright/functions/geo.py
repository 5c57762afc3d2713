"""Distances as Column expressions, and the grid that finds neighbours within a radius."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Earth's radius in statute miles, road circuity, and average speed in miles an hour.
EARTH_MILES, CIRCUITY, SPEED = 3958.7613, 1.25, 35


def half_up(x: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(x + 0.5)


def to_tenth(x: Column) -> Column:
    return half_up(x * 10) / 10


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles; null if a coordinate is."""
    s1, s2 = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.when(h.isNotNull(), F.lit(2 * EARTH_MILES) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def drive_minutes(miles: Column) -> Column:
    return half_up(miles * CIRCUITY / SPEED * 60).cast("long")


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean of two scores; 0 if either is not positive."""
    return F.when((a > 0) & (b > 0), 2.0 * a * b / (a + b)).otherwise(0.0)


def proximity(miles: Column, radius: Column | float) -> Column:
    """1 at no distance, 0 from the radius on."""
    return F.when(miles.isNull() | (miles >= radius), 0.0).otherwise(1 - F.pow(miles / radius, F.lit(1.5)))


def _band(lat: Column, radius: float) -> Column:
    return F.floor((lat + 90) / F.degrees(F.lit(radius / EARTH_MILES)))


def _cells_around(band: Column, radius: float) -> Column:
    """How many cells a band of latitude has: each at least as wide as the radius reaches there."""
    step = F.degrees(F.lit(radius / EARTH_MILES))
    widest = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * step - 90), F.abs((band + 2) * step - 90)))
    ratio = F.sin(F.lit(radius / (2 * EARTH_MILES))) / F.greatest(F.cos(F.radians(widest)), F.lit(1e-9))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio)))))


def with_cell(df: DataFrame, radius: float) -> DataFrame:
    """df (lat, lon) with its grid cell as band and cell."""
    band = _band(F.col("lat"), radius)
    n = _cells_around(band, radius)
    return df.withColumns({"band": band, "cell": F.pmod(F.floor((F.col("lon") + 180) / 360 * n), n)})


def with_near_cells(df: DataFrame, radius: float) -> DataFrame:
    """df once for each cell that may hold points within the radius; neighbours meet in exactly one."""
    df = df.withColumn("band", F.explode(F.sequence(_band(F.col("lat"), radius) - 1, _band(F.col("lat"), radius) + 1)))
    n = _cells_around(F.col("band"), radius)
    at = F.floor((F.col("lon") + 180) / 360 * n)
    return df.withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(at - 1, at, at + 1), lambda c: F.pmod(c, n)))))


def with_cells_of_box(df: DataFrame, radius: float, width: float) -> DataFrame:
    """df (min_lat, max_lat, min_lon, max_lon) once for each cell of the grid for `width` that may hold points within `radius` of the box."""
    reach = math.degrees(radius / EARTH_MILES) * 1.0001
    low, high = (F.greatest(F.lit(-90.0), F.least(F.lit(90.0), x)) for x in (F.col("min_lat") - reach, F.col("max_lat") + reach))
    widest = F.greatest(F.abs(F.col("min_lat") - reach), F.abs(F.col("max_lat") + reach))
    ratio = F.when(widest >= 90, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.sin(F.lit(radius / (2 * EARTH_MILES))) / F.cos(F.radians(widest))))
    beside = F.degrees(2 * F.asin(ratio)) * 1.0001
    df = df.withColumn("band", F.explode(F.sequence(_band(low, width), _band(high, width))))
    n = _cells_around(F.col("band"), width)
    first = F.floor((F.col("min_lon") - beside + 180) / 360 * n)
    last = F.least(F.floor((F.col("max_lon") + beside + 180) / 360 * n), first + n - 1)
    return df.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(first, last), lambda c: F.pmod(c, n)))))
