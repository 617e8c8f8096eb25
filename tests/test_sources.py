"""Readers on small files, and the stream against the batch."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from fieldloom.operators import landcover
from fieldloom.plans.streams import replay
from fieldloom.sources import files
from fieldloom.streaming import confirm


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path / name}"


def test_delimited_tables(spark, tmp_path):
    path = put(tmp_path, "a.csv", "date;NDVI;note;NDVI\n2020-01-05;0.5;x;1\n2020-01-21;n/a;;2\n13/02/2020;0.7;y;3e1\n")
    t = files.build_table(files.read_cells(spark, path))
    assert t.dtypes == [("date", "date"), ("NDVI", "double"), ("note", "string"), ("NDVI_2", "double")]
    assert [tuple(r) for r in t.orderBy("date").collect()][1] == (datetime.date(2020, 1, 21), None, None, 2.0)


def test_coordinates(spark, tmp_path):
    path = put(tmp_path, "p.csv", "Lat,Lon,Elev\n10,20,5\n95,20,1\nx,1,\n")
    x = files.coordinates(files.read_cells(spark, path)).collect()
    assert [r.valid for r in x] == [True, False, False] and x[0].elevation == 5


def test_vector_files(spark, tmp_path):
    g = put(tmp_path, "g.json", '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"a","n":1},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":null,"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}}]}')
    rows = files.geojson(spark, g).orderBy("feature").collect()
    assert [r.type for r in rows] == ["Point", "LineString"] and rows[0].properties == {"name": "a", "n": "1"} and rows[1].coordinates == "[[0,0],[1,1]]"
    bare = files.geojson(spark, put(tmp_path, "b.json", '{"type":"Point","coordinates":[3,4]}')).first()
    assert (bare.type, bare.coordinates) == ("Point", "[3,4]")
    k = put(tmp_path, "k.kml", "<kml><Document><Placemark><name>f</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,5 1,0 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark><Placemark><name>p</name><Point><coordinates>7,8</coordinates></Point></Placemark></Document></kml>")
    rows = {r.name: r for r in files.kml(spark, k).collect()}
    assert rows["f"].kind == "Polygon" and len(rows["f"].points) == 3 and rows["f"].points[0].z == 5 and rows["p"].points[0].x == 7
    x = put(tmp_path, "t.gpx", '<gpx><trk><trkseg><trkpt lat="1" lon="2"><ele>3</ele></trkpt><trkpt lat="1.5" lon="2.5"/></trkseg></trk></gpx>')
    assert [(r.i, r.lon, r.elevation) for r in files.gpx_tracks(spark, x).orderBy("i").collect()] == [(0, 2.0, 3.0), (1, 2.5, None)]


def test_service_answers(spark, tmp_path):
    a = put(tmp_path, "w.json", '{"daily":{"time":["2020-01-01","2020-01-02"],"rain":[1.5,null]}}')
    assert [tuple(r) for r in files.daily_weather(spark, a, ["rain"]).orderBy("d").collect()] == [(datetime.date(2020, 1, 1), 1.5), (datetime.date(2020, 1, 2), None)]
    b = put(tmp_path, "n.json", '{"properties":{"parameter":{"T2M":{"20200101":5.0,"20200102":-999.0},"P":{"20200102":2.0}}}}')
    assert [tuple(r) for r in files.daily_power(spark, b, ["T2M", "P"]).orderBy("d").collect()] == [(datetime.date(2020, 1, 1), 5.0, None), (datetime.date(2020, 1, 2), None, 2.0)]


def test_inventory(spark, tmp_path):
    p = put(tmp_path, "i.csv", 'site,north\n\nPlot,Species,GBH,Height\n1,oak,"31,4",10\n1,ash,62.8,\n---\nend,x,1,1\n'.replace('"31,4"', "31.4"))
    rows = files.inventory(spark, p).orderBy("i").collect()
    assert [r.species for r in rows] == ["oak", "ash"] and abs(rows[0].dbh - 9.995) < 0.01 and rows[1].height is None


def test_stream_equals_batch(spark):
    at = [datetime.datetime(2024, 1, d) for d in range(1, 8)]
    values = {1: [0.7, 0.4, None, 0.3, 0.2, 0.7, 0.1], 2: [0.7, 0.4, 0.7, 0.4, 0.7, 0.4, 0.7], 3: [0.1] * 7}
    rows = [(c, t, v, 0.3 if c == 3 else 0.75) for c, vs in values.items() for t, v in zip(at, vs, strict=True)]
    df = spark.createDataFrame(rows, "cell long, at timestamp, value double, reference double")
    batch = confirm.confirm_batch(df).collect()
    assert [(r.cell, r.since, r.confirmed) for r in batch] == [(1, at[1], at[3])]
    assert [tuple(r) for r in replay(spark, df.coalesce(1), confirm.confirm).collect()] == [tuple(r) for r in batch]


def test_late_scenes_are_ignored():
    x = pd.DataFrame({"at": pd.to_datetime(["2024-01-05"]), "value": [0.3], "reference": [0.8]})
    state, found = confirm.advance((0.8, None, pd.Timestamp("2024-01-06"), False), x)
    assert found == [] and state[1] is None


def test_clusters_and_folds(spark):
    x = spark.createDataFrame([(i, float(i % 3) * 10 + 0.01 * i, float(i % 3)) for i in range(300)], "id int, a double, b double")
    got = landcover.clusters(x, ["a", "b"], 3, "a", ["id"]).groupBy("class").agg(F.count("*").alias("n"), F.avg("a").alias("m")).orderBy("class").collect()
    assert [r.n for r in got] == [100, 100, 100] and got[0].m < got[1].m < got[2].m
    shapes = spark.createDataFrame([("w", i) for i in range(7)] + [("f", 100 + i) for i in range(4)], "label string, shape int")
    f = landcover.folds(shapes, "label", "shape").toPandas()
    assert f.fold.max() == 3 and (f.groupby("label").fold.nunique() == 4).all()


def test_a_drop_that_rounding_hides_counts():
    x = pd.DataFrame({"at": pd.to_datetime(["2024-01-01", "2024-01-02"]), "value": [40.0 / 100, 0.082], "reference": [0.6, 0.6]})
    _, found = confirm.advance((None, None, None, False), x)
    assert found == [(pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-02"), 0.082)]
