"""Measures on the ellipsoid, as Column expressions: distances and bearings, areas of rings, transverse Mercator zones and the ground that cells cover."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators.vector import E2, MERCATOR, RADIUS, cell_area

# The ellipsoid's equatorial radius (m) and flattening; the scale, false easting and northing of the zones.
A, FLAT = 6378137.0, 1 / 298.257223563
ZONE_SCALE, EASTING, SOUTH_NORTHING = 0.9996, 500_000.0, 10_000_000.0
B, SECOND = A * (1 - FLAT), (A**2 - (A * (1 - FLAT)) ** 2) / (A * (1 - FLAT)) ** 2
#: Steps of the inverse problem; all but nearly opposite places settle to the last bits in fewer.
STEPS = 12


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def lets(use: Callable[..., Column], **values: Column) -> Column:
    """use(**values), each worked out once."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), lambda s: use(**{k: s[k] for k in values}))


def inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Struct of distance (m) and bearing (degrees from north, 0 to 360) of the shortest line from the first to the second place.

    The difference of longitude on the auxiliary sphere is found in a fixed number of steps (Vincenty's series, good to a millimetre). It is null
    where they don't settle, for places nearly opposite each other. Equal places have distance 0 and bearing 0.
    """
    reduced = lambda lat: F.atan((1 - FLAT) * F.tan(F.radians(lat)))
    turned = F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180)

    def solved(s1: Column, c1: Column, s2: Column, c2: Column, dl: Column) -> Column:
        def around(lam: Column, use: Callable[..., Column]) -> Column:
            """use() of the arc's sine, cosine and length, its azimuth at the equator (sine, squared cosine) and the cosine of twice the middle."""
            first = {"x": c2 * F.sin(lam), "y": c1 * s2 - s1 * c2 * F.cos(lam), "cs": s1 * s2 + c1 * c2 * F.cos(lam)}

            def second(x: Column, y: Column, cs: Column) -> Column:
                def third(ss: Column, x: Column, y: Column, cs: Column) -> Column:
                    sa = F.coalesce(F.try_divide(c1 * x, ss), F.lit(0.0))
                    return lets(lambda sa, ca2, ss, cs, x, y: lets(use, sa=sa, ca2=ca2, ss=ss, cs=cs, x=x, y=y, sigma=F.atan2(ss, cs), cm=F.when(ca2 > 1e-15, cs - 2 * s1 * s2 / ca2).otherwise(0.0)), sa=sa, ca2=1 - sa * sa, ss=ss, cs=cs, x=x, y=y)

                return lets(third, ss=F.sqrt(x * x + y * y), x=x, y=y, cs=cs)

            return lets(second, **first)

        def step(lam: Column, _: Column) -> Column:
            def new(sa, ca2, ss, cs, x, y, sigma, cm):  # noqa: ANN001, ANN202
                return let(FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2)), lambda c: dl + (1 - c) * FLAT * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))))

            return F.struct(around(lam["at"], new).alias("at"), lam["at"].alias("was"))

        def measured(lam: Column) -> Column:
            def out(sa, ca2, ss, cs, x, y, sigma, cm):  # noqa: ANN001, ANN202
                def far(u: Column) -> Column:
                    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
                    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
                    less = lambda b: b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
                    return B * big * (sigma - let(small, less))

                return F.struct(let(ca2 * SECOND, far).alias("distance"), F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0)).alias("bearing"))

            return F.when(F.abs(lam["at"] - lam["was"]) < 1e-9, around(lam["at"], out))

        start = F.struct(dl.alias("at"), (dl + 1).alias("was"))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step), measured)

    whole = lets(lambda u1, u2, dl: lets(solved, s1=F.sin(u1), c1=F.cos(u1), s2=F.sin(u2), c2=F.cos(u2), dl=dl), u1=reduced(lat1), u2=reduced(lat2), dl=turned)
    same = F.struct(F.lit(0.0).alias("distance"), F.lit(0.0).alias("bearing"))
    return F.when((turned == 0) & (lat1 == lat2), same).otherwise(whole)


def _authalic_half(lat: Column) -> Column:
    """Half the latitude, in radians, at which a sphere of the ellipsoid's area has as much area below."""
    e = math.sqrt(E2)
    q = lambda s: (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    pole = (1 - E2) * (1 / (1 - E2) - math.log((1 - e) / (1 + e)) / (2 * e))
    return F.asin(F.least(F.greatest(let(F.sin(F.radians(lat)), q) / pole, F.lit(-1.0)), F.lit(1.0))) / 2


def under_edge(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Signed area (m2) between an edge and the equator, on the sphere of the ellipsoid's area; edges of 100 km are off by a millionth of a square of their size."""
    t1, t2 = F.tan(_authalic_half(lat1)), F.tan(_authalic_half(lat2))
    half = F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180) / 2
    return lets(lambda a, b, h: RADIUS**2 * 2 * F.atan2(F.tan(h) * (a + b), 1 + a * b), a=t1, b=t2, h=half)


def legs(vertices: DataFrame, *keys: str) -> DataFrame:
    """The vertices (keys, i, lon, lat, closed: whether the last leads to the first) with distance and bearing of the leg to the next one, null at a line's end, and along, the distance from the first.

    One line's vertices are one window; lines are many.
    """
    order = W.partitionBy(*keys).orderBy("i")
    first = lambda c: F.first(c).over(order.rowsBetween(W.unboundedPreceding, 0))
    x = vertices.withColumns({"next_lon": F.coalesce(F.lead("lon").over(order), F.when(F.col("closed"), first("lon"))), "next_lat": F.coalesce(F.lead("lat").over(order), F.when(F.col("closed"), first("lat")))})
    x = x.withColumn("leg", F.when(F.col("next_lon").isNotNull(), inverse(F.col("lon"), F.col("lat"), F.col("next_lon"), F.col("next_lat"))))
    return x.select(*vertices.columns, "next_lon", "next_lat", F.col("leg.distance").alias("distance"), F.col("leg.bearing").alias("bearing"), F.coalesce(F.sum("leg.distance").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("along"))


def open_rings(vertices: DataFrame, *keys: str) -> DataFrame:
    """Vertices without a last one that repeats the first of a closed line."""
    order = W.partitionBy(*keys).orderBy("i")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    again = F.col("closed") & F.lead("i").over(order).isNull() & (F.count("*").over(every) > 1) & (F.col("lon") == F.first("lon").over(every)) & (F.col("lat") == F.first("lat").over(every))
    return vertices.withColumn("again", again).where(~F.col("again")).drop("again")


def survey(vertices: DataFrame, feature: str) -> DataFrame:
    """A row a feature: vertices, length (of lines) or perimeter and area (of rings: the first less the others), centre (mean of the first ring's vertices) and range of elevations, unless all are 0.

    vertices: feature, ring (0: the outer one, or the line), i, closed, lon, lat, elevation. Rings of fewer than three vertices measure nothing.
    """
    x = legs(open_rings(vertices, feature, "ring"), feature, "ring")
    x = x.withColumn("under", F.when(F.col("closed"), under_edge(F.col("lon"), F.col("lat"), F.col("next_lon"), F.col("next_lat"))))
    r = x.groupBy(feature, "ring").agg(F.count("*").alias("n"), F.bool_or("closed").alias("closed"), F.sum("distance").alias("length"), F.abs(F.sum("under")).alias("area"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat"), F.min("elevation").alias("low"), F.max("elevation").alias("high"))
    r = r.where("not closed or n >= 3")
    outer = F.col("ring") == 0
    sign = F.when(outer, F.col("area")).otherwise(-F.col("area"))
    out = r.groupBy(feature).agg(F.sum("n").alias("vertices"), F.sum(F.when(outer, F.col("length"))).alias("length"), F.sum(sign).alias("area"), (F.sum(F.when(outer, F.col("lon"))) / F.sum(F.when(outer, F.col("n")))).alias("lon"), (F.sum(F.when(outer, F.col("lat"))) / F.sum(F.when(outer, F.col("n")))).alias("lat"), F.min("low").alias("low"), F.max("high").alias("high"))
    flat = (F.col("low") == 0) & (F.col("high") == 0)
    return out.withColumns({"low": F.when(~flat, F.col("low")), "high": F.when(~flat, F.col("high"))})


def _series() -> tuple[float, list[float]]:
    """Radius of the rectifying sphere and Krüger's coefficients to the fourth order of the third flattening."""
    n = FLAT / (2 - FLAT)
    return A / (1 + n) * (1 + n**2 / 4 + n**4 / 64), [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]


def zone_of(lon: Column) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)


def zoned(lon: Column, lat: Column) -> Column:
    """Struct of zone, south, easting and northing (m) of a place in its universal transverse Mercator zone."""
    radius, series = _series()
    e = math.sqrt(E2)
    away = F.radians(lon - (zone_of(lon) * 6 - 183))
    # Fixed-order series on the conformal latitude.
    tau = lambda s: F.sinh(F.atanh(s) - e * F.atanh(e * s))

    def grid(t: Column, w: Column) -> Column:
        def summed(xi: Column, eta: Column) -> Column:
            north, east = xi, eta
            for k, a in enumerate(series, 1):
                north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
                east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
            return F.struct(zone_of(lon).alias("zone"), (lat < 0).alias("south"), (EASTING + ZONE_SCALE * radius * east).alias("easting"), (F.when(lat < 0, SOUTH_NORTHING).otherwise(0.0) + ZONE_SCALE * radius * north).alias("northing"))

        return lets(summed, xi=F.atan2(t, F.cos(w)), eta=F.asinh(F.sin(w) / F.sqrt(t * t + F.cos(w) * F.cos(w))))

    return lets(grid, t=let(F.sin(F.radians(lat)), tau), w=away)


def zone_label(lon: Column, lat: Column) -> Column:
    """Zone with N or S, easting and northing in whole metres."""
    return let(zoned(lon, lat), lambda z: F.concat(z["zone"], F.when(z["south"], "S").otherwise("N"), F.lit(" "), F.rint(z["easting"]).cast("long"), F.lit(" E "), F.rint(z["northing"]).cast("long"), F.lit(" N")))


def mercator_latitude(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR)) - math.pi / 2)


def ground(kind: str, row: Column, top: float, width: float, height: float) -> tuple[Column, Column, Column]:
    """dx, dy (m) and area (m2) of the cells of a row of a grid whose upper edge is at `top` and whose cells are width x height: degrees for `geographic`, metres for `mercator` and `zone`.

    Geographic cells have their exact area on the ellipsoid; the web map's are corrected for latitude; those of zones are as they are.
    """
    upper, middle, lower = (F.lit(top) - (row + k) * height for k in (0, 0.5, 1))
    if kind == "geographic":
        return RADIUS * math.radians(width) * F.cos(F.radians(middle)), F.lit(RADIUS * math.radians(height)), cell_area(upper, lower, F.lit(width))
    if kind == "mercator":
        c = F.cos(F.radians(mercator_latitude(middle)))
        return width * c, height * c, width * height * c * c
    if kind == "zone":
        return F.lit(width), F.lit(height), F.lit(width * height)
    raise ValueError(f"unknown kind of grid {kind!r}; known are geographic, mercator and zone")
