"""Measures on the ellipsoid against known values and closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import geodesy, vector

# Distances (m) and bearings on the ellipsoid of well-known lines.
LINES = [
    (94.1, 25.67, 94.1, 25.68, 1107.830, 0.0),
    (0.0, 0.0, 1.0, 0.0, 111319.4908, 90.0),
    (0.0, 0.0, 0.0, 90.0, 10001965.7293, 0.0),
    (-5.71475, 50.06632, -3.07009, 58.64402, 969954.1663, 9.1419),
    (10.0, -90.0, 10.0, 90.0, 20003931.4586, 0.0),
    (5.0, 5.0, 5.0, 5.0, 0.0, 0.0),
]


def test_lines_of_known_length(spark):
    x = spark.createDataFrame(LINES, "a double, b double, c double, d double, m double, bearing double").withColumn("g", geodesy.inverse(*map(F.col, "abcd")))
    for r in x.collect():
        assert r.g.distance == pytest.approx(r.m, abs=1e-3) and r.g.bearing == pytest.approx(r.bearing, abs=1e-4)
    odd = spark.createDataFrame([(10.0, 20.0, 190.0, -20.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double").select(geodesy.inverse(*map(F.col, "abcd")).alias("g")).collect()
    assert [r.g for r in odd] == [None, None]
    date_line = spark.range(1).select(geodesy.inverse(*map(F.lit, (179.9, 10.0, -179.9, 10.0))).alias("g")).first().g
    assert date_line.distance == pytest.approx(21927.8725, abs=1e-3)


def test_zones(spark):
    x = spark.createDataFrame([(3.0, 0.0), (0.0, 0.0), (151.2153, -33.8568), (180.0, 10.0)], "lon double, lat double")
    got = [r.z for r in x.select(geodesy.zoned(F.col("lon"), F.col("lat")).alias("z")).collect()]
    assert [(z.zone, z.south) for z in got] == [(31, False), (31, False), (56, True), (60, False)]
    assert (got[0].easting, got[0].northing) == (500_000, 0) and got[1].easting == pytest.approx(166021.4431, abs=1e-3)
    # A degree along the central meridian is the meridian's arc at the zone's scale.
    arc = spark.range(1).select(geodesy.inverse(*map(F.lit, (9.0, 45.0, 9.0, 46.0)))["distance"].alias("d"), (geodesy.zoned(F.lit(9.0), F.lit(46.0))["northing"] - geodesy.zoned(F.lit(9.0), F.lit(45.0))["northing"]).alias("n")).first()
    assert arc.n == pytest.approx(arc.d * 0.9996, abs=1e-3)
    assert x.select(geodesy.zone_label(F.col("lon"), F.col("lat")).alias("l")).first().l == "31N 500000 E 0 N"


RING = [(94.1, 25.67, 1400.0), (94.11, 25.67, 1410.0), (94.11, 25.68, 1420.0), (94.1, 25.68, 1405.0)]
HOLE = [(94.104, 25.674, 0.0), (94.106, 25.674, 0.0), (94.106, 25.676, 0.0), (94.104, 25.676, 0.0)]
DDL = "f string, ring int, i int, closed boolean, lon double, lat double, elevation double"


def test_survey_of_rings_and_lines(spark):
    rows = [("box", 0, i, True, *v) for i, v in enumerate([*RING, RING[0]])] + [("box", 1, i, True, *v) for i, v in enumerate(HOLE)]
    rows += [("walk", 0, i, False, lon, lat, 0.0) for i, (lon, lat, _) in enumerate(RING)] + [("short", 0, 0, True, 1.0, 1.0, None), ("short", 0, 1, True, 2.0, 1.0, None)]
    vertices = spark.createDataFrame(rows, DDL)
    got = {r.f: r for r in geodesy.survey(vertices, "f").collect()}
    rect = lambda a, b, w: spark.range(1).select(vector.cell_area(F.lit(b), F.lit(a), F.lit(w))).first()[0]
    assert set(got) == {"box", "walk"} and (got["box"].vertices, got["walk"].vertices) == (8, 4)
    assert got["box"].area == pytest.approx(rect(25.67, 25.68, 0.01) - rect(25.674, 25.676, 0.002), rel=5e-4)
    assert (got["box"].lon, got["box"].lat) == (pytest.approx(94.105), pytest.approx(25.675)) and (got["box"].low, got["box"].high) == (0.0, 1420.0)
    assert got["walk"].area is None and (got["walk"].low, got["walk"].high) == (None, None)
    legs = geodesy.legs(geodesy.open_rings(vertices.where("f = 'box' and ring = 0"), "f", "ring"), "f", "ring").orderBy("i").collect()
    assert [round(r.bearing) for r in legs] == [90, 0, 270, 180] and legs[1].distance == pytest.approx(1107.83, abs=0.01)
    assert got["box"].length == pytest.approx(sum(r.distance for r in legs)) and legs[3].along == pytest.approx(sum(r.distance for r in legs[:3]))
    line = geodesy.legs(vertices.where("f = 'walk'"), "f").orderBy("i").collect()
    assert line[3].distance is None and got["walk"].length == pytest.approx(line[3].along)


def test_area_of_a_hemisphere_and_across_the_date_line(spark):
    ring = lambda *p: spark.createDataFrame([("r", 0, i, True, float(x), float(y), None) for i, (x, y) in enumerate(p)], DDL)
    area = lambda df: geodesy.survey(df, "f").first().area
    assert area(ring((0, 0), (90, 0), (0, 90))) == pytest.approx(math.pi / 2 * vector.RADIUS**2, rel=1e-9)
    assert area(ring((179, 10), (-179, 10), (-179, 12), (179, 12))) == pytest.approx(area(ring((9, 10), (11, 10), (11, 12), (9, 12))), rel=1e-12)


def test_ground_of_rows(spark):
    rows = spark.range(10).selectExpr("CAST(id AS INT) AS row")
    dx, dy, area = geodesy.ground("geographic", F.col("row"), 26.0, 0.1, 0.1)
    total = rows.select(F.sum(area * 10)).first()[0]
    assert total == pytest.approx(spark.range(1).select(vector.cell_area(F.lit(26.0), F.lit(25.0), F.lit(1.0))).first()[0], rel=1e-9)
    dx, dy, area = geodesy.ground("mercator", F.col("row"), 8_399_737.9, 1.0, 1.0)  # 60 degrees north
    r = rows.select(dx.alias("dx"), dy.alias("dy"), area.alias("area")).first()
    assert (r.dx, r.dy, r.area) == (pytest.approx(0.5, abs=1e-5), pytest.approx(0.5, abs=1e-5), pytest.approx(0.25, abs=1e-5))
    with pytest.raises(ValueError, match="unknown kind"):
        geodesy.ground("other", F.col("row"), 0.0, 1.0, 1.0)
