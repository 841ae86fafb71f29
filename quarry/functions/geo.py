"""Distances on the sphere, centroids and the radius join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    return f"2 * {EARTH_KM} * asin(least(1.0, sqrt({h})))"


def centroids(items: DataFrame) -> DataFrame:
    """(location, c_lat, c_lon): medians of the items of each location; rows without a location or place are left out."""
    placed = items.filter("location is not null and lat is not null and lon is not null")
    return placed.groupBy("location").agg(F.median("lat").alias("c_lat"), F.median("lon").alias("c_lon"))


def radius_join(centres: DataFrame, items: DataFrame, km: float) -> DataFrame:
    """Pairs of centres (…, c_lat, c_lon) and items (…, lat, lon) at most km apart, with `dist_km`.

    An equi-join on grid cells: cells are `step` degrees high, as wide in longitude as the highest latitude a circle
    reaches asks for, and wrap at 180 degrees. Each centre covers the cells about it; the exact distance decides.
    """
    step = math.degrees(km / EARTH_KM) * 1.001
    cell = lambda c: F.floor(c / step)
    cells = math.ceil(360 / step)
    reach = F.col("c_lat").cast("double")
    # Half-width in longitude at the circle's highest latitude, the whole parallel near the poles.
    top = F.least(F.greatest(F.abs(reach + step), F.abs(reach - step)), F.lit(90.0))
    half = F.when(top >= 89.0, F.lit(180.0)).otherwise(F.lit(step) / F.cos(F.radians(top)))
    wide = centres.withColumn("_i", F.explode(F.sequence(cell(reach - step), cell(reach + step)))).withColumn(
        "_j", F.explode(F.array_distinct(F.transform(F.sequence(cell(F.col("c_lon") - half), cell(F.col("c_lon") + half)), lambda j: F.pmod(j, F.lit(cells)))))
    )
    placed = items.filter("lat is not null and lon is not null").withColumn("_i", cell(F.col("lat"))).withColumn("_j", F.pmod(cell(F.col("lon")), F.lit(cells)))
    near = wide.join(placed, ["_i", "_j"]).withColumn("dist_km", haversine_km(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon")))
    return near.filter(F.col("dist_km") <= km).drop("_i", "_j")
