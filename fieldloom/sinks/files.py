"""Files that other programs read: features as GeoJSON, KML and GPX, tables as CSV. Each row becomes one element of text, so writing is a distributed text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """Text for XML."""
    x = text.cast("string")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return x


def geojson_features(df: DataFrame, lon: str, lat: str, *properties: str) -> DataFrame:
    """One column, value: a GeoJSON point feature a row. A missing coordinate gives a null geometry; missing properties stay as nulls."""
    place = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def kml_placemarks(df: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
    """One column, value: a KML placemark a row; rows without coordinates are left out."""
    at = F.concat_ws(",", F.col(lon).cast("string"), F.col(lat).cast("string"))
    text = F.concat(F.lit("<Placemark><name>"), F.coalesce(escaped(F.col(name)), F.lit("")), F.lit("</name><Point><coordinates>"), at, F.lit("</coordinates></Point></Placemark>"))
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(text.alias("value"))


def gpx_waypoints(df: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
    """One column, value: a GPX waypoint a row; rows without coordinates are left out."""
    text = F.concat(F.lit('<wpt lat="'), F.col(lat).cast("string"), F.lit('" lon="'), F.col(lon).cast("string"), F.lit('"><name>'), F.coalesce(escaped(F.col(name)), F.lit("")), F.lit("</name></wpt>"))
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(text.alias("value"))


# What stands before and after the elements of a whole document.
WRAPPERS = {
    "geojson": ('{"type":"FeatureCollection","features":[', "]}"),
    "kml": ('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"),
    "gpx": ('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="fieldloom" xmlns="http://www.topografix.com/GPX/1/1">', "</gpx>"),
}


def documents(elements: DataFrame, kind: str, size: int = 50_000) -> DataFrame:
    """Whole documents of about `size` elements each, one a row, so that none holds the table. Elements are dealt by their hashes, in the order of their text."""
    parts = max(1, -(-elements.count() // size))
    head, tail = WRAPPERS[kind]
    comma = "," if kind == "geojson" else ""
    x = elements.groupBy(F.pmod(F.xxhash64("value"), F.lit(parts)).alias("part")).agg(F.concat_ws(comma, F.sort_array(F.collect_list("value"))).alias("body"))
    return x.select(F.concat(F.lit(head), "body", F.lit(tail)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header each; dates in ISO form."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_text(elements: DataFrame, path: str) -> None:
    elements.write.mode("overwrite").text(path)
