"""Files for other programs: text of elements, whole documents, and reading back."""

import json
import xml.etree.ElementTree as ET

from fieldloom.operators import networks
from fieldloom.sinks import files


def _places(spark):
    return spark.createDataFrame([(1.5, 2.0, "a & b", 1), (None, 3.0, "<none>", 2), (4.0, 5.0, None, 3)], "lon double, lat double, name string, n int")


def test_features_and_documents(spark):
    x = files.geojson_features(_places(spark), "lon", "lat", "name", "n")
    whole = [json.loads(r.value) for r in files.documents(x, "geojson", size=2).collect()]
    got = sorted((f["properties"]["n"], f["geometry"] and f["geometry"]["coordinates"], f["properties"]["name"]) for d in whole for f in d["features"])
    assert got == [(1, [1.5, 2.0], "a & b"), (2, None, "<none>"), (3, [4.0, 5.0], None)]
    for kind, make, tag in (("kml", files.kml_placemarks, "Placemark"), ("gpx", files.gpx_waypoints, "wpt")):
        (text,) = [r.value for r in files.documents(make(_places(spark), "lon", "lat", "name"), kind).collect()]
        root = ET.fromstring(text)
        assert len([e for e in root.iter() if e.tag.endswith("}" + tag)]) == 2 and "a & b" in "".join(root.itertext())
        assert files.documents(make(_places(spark).where("false"), "lon", "lat", "name"), kind).count() == 0


def test_csv_is_read_again(spark, tmp_path):
    files.write_csv(_places(spark), f"file://{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/t").where("name = 'a & b'").count() == 1


def test_alerts_are_told_once(spark):
    from pyspark.sql import functions as F

    g = spark.createDataFrame([(0, 0, True, False), (0, 1, True, False), (5, 5, True, False), (9, 9, False, False)], "row int, col int, confirmed boolean, reported boolean")
    alerts, after = networks.emit_alerts(g, 10, F.lit(1.0), 2.0)
    assert [(a.patch, a.cells) for a in alerts.collect()] == [(0, 2)]
    again, _ = networks.emit_alerts(after, 10, F.lit(1.0), 2.0)
    assert again.count() == 0 and after.where("reported").count() == 2
