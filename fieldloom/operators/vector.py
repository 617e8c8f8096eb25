"""Vectors: points in polygons, rings, legs and areas; and XYZ tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Authalic radius (m), squared eccentricity, equatorial radius of the web map.
RADIUS, E2, MERCATOR = 6371007.1809, 0.00669437999014, 6378137.0


def points_in_polygons(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """x, y and polygon of each point inside: even-odd over all rings, so holes are out. rings: polygon, ring, i, x, y (closed or not).

    Points and edges meet by bands of y of the given height; an edge is in every band that it crosses, so there is no cross join.
    """
    w = W.partitionBy("polygon", "ring").orderBy("i")
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(w)), F.coalesce(F.lead("y").over(w), F.first("y").over(w))
    e = rings.select("polygon", F.col("x").alias("x1"), F.col("y").alias("y1"), nx.alias("x2"), ny.alias("y2")).where("y1 <> y2")
    band = lambda c: F.floor(c / cell).cast("int")
    e = e.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    p = points.select("x", "y").distinct().withColumn("band", band(F.col("y")))
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    return p.join(e, "band").where(crossing).groupBy("x", "y", "polygon").agg(F.count("*").alias("n")).where("n % 2 = 1").select("x", "y", "polygon")


def legs(vertices: DataFrame, closed: bool, *keys: str) -> DataFrame:
    """Leg from each vertex to the next (the last to the first for rings): plane length and cumulative distance. vertices: keys, i, x, y."""
    w = W.partitionBy(*keys).orderBy("i")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    if closed:
        nx, ny = F.coalesce(nx, F.first("x").over(w)), F.coalesce(ny, F.first("y").over(w))
    x = vertices.withColumn("leg", F.hypot(nx - F.col("x"), ny - F.col("y")))
    return x.withColumn("along", F.coalesce(F.sum("leg").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))


def ring_areas(vertices: DataFrame, *keys: str) -> DataFrame:
    """Area and perimeter of rings by the shoelace formula."""
    w = W.partitionBy(*keys).orderBy("i")
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(w)), F.coalesce(F.lead("y").over(w), F.first("y").over(w))
    x = vertices.withColumns({"cross": F.col("x") * ny - nx * F.col("y"), "leg": F.hypot(nx - F.col("x"), ny - F.col("y"))})
    return x.groupBy(*keys).agg(F.count("*").alias("vertices"), (F.abs(F.sum("cross")) / 2).alias("area"), F.sum("leg").alias("perimeter"))


def _q(latitude: Column) -> Column:
    s, e = F.sin(F.radians(latitude)), math.sqrt(E2)
    return (1 - E2) * (s / (1 - E2 * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))


def cell_area(top: Column, bottom: Column, width: Column) -> Column:
    """Area in square metres of a cell of the ellipsoid between two latitudes, width in degrees."""
    pole = (1 - E2) * (1 / (1 - E2) - math.log((1 - math.sqrt(E2)) / (1 + math.sqrt(E2))) / (2 * math.sqrt(E2)))
    return RADIUS**2 * F.radians(width) * F.abs(_q(top) - _q(bottom)) / pole


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web map tile that holds a place."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    return F.least(F.greatest(x, F.lit(0)), F.lit(n - 1)).cast("int"), F.least(F.greatest(y, F.lit(0)), F.lit(n - 1)).cast("int")


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    """Distance in metres on a sphere of the mean radius."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def magnetic_bearing(true: Column, declination: Column) -> Column:
    return F.pmod(true - declination, F.lit(360.0))
