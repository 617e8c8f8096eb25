"""Measures on the ellipsoid over a stand-in of tracks: a customer's orders as places, in order of their keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import geodesy
from fieldloom.operators.vector import E2, RADIUS
from fieldloom.plans.registry import query, table


def _tracks(spark: SparkSession, sf_dir: str, closed: bool) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    lon, lat = F.col("o_custkey") * 7919 % 36000 / 100.0 - 180 + F.col("o_orderkey") % 997 / 1000.0, F.col("o_custkey") * 104729 % 14000 / 100.0 - 70 + F.col("o_orderkey") % 991 / 1000.0
    return o.select(F.col("o_custkey").alias("feature"), F.lit(0).alias("ring"), F.col("o_orderkey").alias("i"), F.lit(closed).alias("closed"), lon.alias("lon"), lat.alias("lat"), F.floor("o_totalprice").cast("double").alias("elevation"))


TRACKS = "tracks AS (SELECT o_custkey AS feature, o_orderkey AS i, o_custkey * 7919 % 36000 / 100.0::DOUBLE - 180 + o_orderkey % 997 / 1000.0::DOUBLE AS lon, o_custkey * 104729 % 14000 / 100.0::DOUBLE - 70 + o_orderkey % 991 / 1000.0::DOUBLE AS lat, floor(o_totalprice) AS elevation FROM orders)"

#: Legs (feature, i, lon, lat, lon2, lat2) solved in steps.
SOLVED = f"""u AS (SELECT *, radians((lon2 - lon + 540) - 360 * floor((lon2 - lon + 540) / 360) - 180) AS dl, atan({1 - geodesy.FLAT!r} * tan(radians(lat))) AS u1, atan({1 - geodesy.FLAT!r} * tan(radians(lat2))) AS u2 FROM pairs),
s0 AS (SELECT feature, i, dl, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, dl AS lam, 0 AS k FROM u WHERE lon2 IS NOT NULL AND NOT (dl = 0 AND lat = lat2)),
it AS (SELECT * FROM s0 UNION ALL SELECT feature, i, dl, s1, c1, s2, c2, dl + (1 - c) * {geodesy.FLAT!r} * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))), k + 1 FROM (SELECT *, {geodesy.FLAT!r} / 16 * ca2 * (4 + {geodesy.FLAT!r} * (4 - 3 * ca2)) AS c FROM (SELECT *, CASE WHEN ca2 > 1e-15 THEN cs - 2 * s1 * s2 / ca2 ELSE 0 END AS cm, atan2(ss, cs) AS sigma FROM (SELECT *, 1 - sa * sa AS ca2 FROM (SELECT *, c1 * x / ss AS sa FROM (SELECT *, sqrt(x * x + y * y) AS ss FROM (SELECT *, c2 * sin(lam) AS x, c1 * s2 - s1 * c2 * cos(lam) AS y, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM it WHERE k < {geodesy.STEPS}))))))),
e AS (SELECT *, {geodesy.SECOND!r} * ca2 AS w, CASE WHEN ca2 > 1e-15 THEN cs - 2 * s1 * s2 / ca2 ELSE 0 END AS cm, atan2(ss, cs) AS sigma FROM (SELECT *, 1 - (c1 * x / ss) ** 2 AS ca2 FROM (SELECT *, sqrt(x * x + y * y) AS ss FROM (SELECT *, c2 * sin(lam) AS x, c1 * s2 - s1 * c2 * cos(lam) AS y, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM it WHERE k = {geodesy.STEPS})))),
solved AS (SELECT feature, i, {geodesy.B!r} * (1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))) * (sigma - b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS distance, degrees(atan2(x, y)) - 360 * floor(degrees(atan2(x, y)) / 360) AS bearing FROM (SELECT *, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS b FROM e)),
legs AS (SELECT p.*, CASE WHEN lon2 IS NULL THEN NULL ELSE coalesce(distance, 0) END AS distance, CASE WHEN lon2 IS NULL THEN NULL ELSE coalesce(bearing, 0) END AS bearing FROM pairs p LEFT JOIN solved s ON s.feature = p.feature AND s.i = p.i)"""


@query(f"""WITH RECURSIVE {TRACKS}, pairs AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM tracks WINDOW w AS (PARTITION BY feature ORDER BY i)), {SOLVED}
SELECT feature, i, round(distance, 4) AS distance, round(bearing, 6) AS bearing, round(coalesce(sum(distance) OVER (PARTITION BY feature ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS along FROM legs""")
def geodesic_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and bearing of each leg of the tracks, and the way so far."""
    x = geodesy.legs(_tracks(spark, sf_dir, False), "feature")
    return x.select("feature", "i", F.round("distance", 4).alias("distance"), F.round("bearing", 6).alias("bearing"), F.round("along", 3).alias("along"))


E = math.sqrt(E2)
POLE = (1 - E2) * (1 / (1 - E2) - math.log((1 - E) / (1 + E)) / (2 * E))


def _share(lat: str) -> str:
    """SQL for the share of the hemisphere's area below a latitude."""
    s = f"sin(radians({lat}))"
    return f"{1 - E2!r} * ({s} / (1 - {E2!r} * {s} * {s}) - ln((1 - {E!r} * {s}) / (1 + {E!r} * {s})) / {2 * E!r}) / {POLE!r}"


def _half(lat: str) -> str:
    return f"tan(asin(greatest(-1, least(1, {_share(lat)}))) / 2)"


@query(f"""WITH RECURSIVE {TRACKS}, pairs AS (SELECT *, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2 FROM tracks WINDOW w AS (PARTITION BY feature ORDER BY i)), {SOLVED},
a AS (SELECT *, {_half('lat')} AS t1, {_half('lat2')} AS t2, tan(radians((lon2 - lon + 540) - 360 * floor((lon2 - lon + 540) / 360) - 180) / 2) AS h FROM legs)
SELECT feature, count(*) AS vertices, round(sum(distance), 3) AS length, round(abs(sum({2 * RADIUS**2!r} * atan2(h * (t1 + t2), 1 + t1 * t2))) / 1e6, 2) AS km2, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat, min(elevation) AS low, max(elevation) AS high FROM a GROUP BY feature HAVING count(*) >= 3""")
def geodesic_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeter, area, centre and elevations of the tracks as rings."""
    x = geodesy.survey(_tracks(spark, sf_dir, True), "feature")
    return x.select("feature", "vertices", F.round("length", 3).alias("length"), F.round(F.col("area") / 1e6, 2).alias("km2"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "low", "high")


def _zoned() -> str:
    radius, series = geodesy._series()
    north = " + ".join([f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(series, 1)])
    east = " + ".join([f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(series, 1)])
    scale = geodesy.ZONE_SCALE * radius
    return f"""z AS (SELECT feature, i, lon, lat, CAST(least(60, floor((lon + 180) / 6) + 1) AS INT) AS zone FROM tracks), t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS w, sinh(atanh(sin(radians(lat))) - {E!r} * atanh({E!r} * sin(radians(lat)))) AS t FROM z),
g AS (SELECT *, atan2(t, cos(w)) AS xi, asinh(sin(w) / sqrt(t * t + cos(w) * cos(w))) AS eta FROM t), zoned AS (SELECT feature, i, zone, lat < 0 AS south, 500000 + {scale!r} * (eta + {east}) AS easting, CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {scale!r} * (xi + {north}) AS northing FROM g)"""


@query(f"WITH {TRACKS}, {_zoned()} SELECT feature, i, zone, south, round(easting, 4) AS easting, round(northing, 4) AS northing FROM zoned")
def zone_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone, easting and northing of each place."""
    z = geodesy.zoned(F.col("lon"), F.col("lat"))
    return _tracks(spark, sf_dir, False).select("feature", "i", z.alias("z")).select("feature", "i", "z.zone", "z.south", F.round("z.easting", 4).alias("easting"), F.round("z.northing", 4).alias("northing"))


@query(f"""WITH r AS (SELECT CAST(vec_id AS INT) AS row, 50 - (vec_id + 0.5) * 0.0001 AS lat, 6800000 - (vec_id + 0.5) * 30 AS y, 50 - vec_id * 0.0001 AS top, 50 - (vec_id + 1) * 0.0001 AS low FROM embeddings), m AS (SELECT *, cos(2 * atan(exp(y / 6378137)) - pi() / 2) AS c FROM r)
SELECT row, round({RADIUS * math.radians(0.0001)!r} * cos(radians(lat)), 6) AS dx, round({RADIUS**2 * math.radians(0.0001)!r} * abs({_share('top')} - {_share('low')}), 4) AS area, round(30 * c, 6) AS web_dx, round(900 * c * c, 6) AS web_area FROM m""")
def ground_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and area of the cells of each row of the grid, read as degrees and as a web map."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"))
    dx, _, area = geodesy.ground("geographic", F.col("row"), 50.0, 0.0001, 0.0001)
    web_dx, _, web_area = geodesy.ground("mercator", F.col("row"), 6_800_000.0, 30.0, 30.0)
    return rows.select("row", F.round(dx, 6).alias("dx"), F.round(area, 4).alias("area"), F.round(web_dx, 6).alias("web_dx"), F.round(web_area, 6).alias("web_area"))
