"""Readers of tables, coordinates, vector files, inventories and service answers, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.dates import parse_date

# Spellings of a missing cell, and the form of a number.
MISSING = ("", "nan", "na", "n/a", "null", "none")
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
# Names of coordinate columns.
LATITUDE, LONGITUDE, ELEVATION = ("lat", "latitude", "y"), ("lon", "lng", "long", "longitude", "x"), ("elevation", "elev", "alt", "altitude", "z", "height")


def delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of , ; | and tab in the first lines; comma if none is there."""
    head = spark.read.text(path).limit(100).select(*[F.sum(F.length("value") - F.length(F.replace("value", F.lit(d)))).alias(n) for d, n in ((",", "a"), (";", "b"), ("|", "c"), ("\t", "d"))]).first()
    counts = list(zip(",;|\t", head, strict=True))
    best = max(counts, key=lambda x: x[1] or 0)
    return best[0] if best[1] else ","


def read_cells(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file as strings, with its header; duplicate or blank headers get numbers."""
    sep = sep or ("\t" if path.endswith(".tsv") else delimiter(spark, path))
    first = spark.read.option("sep", sep).option("multiLine", True).csv(path).limit(1).first()
    names, seen = [], {}
    for i, x in enumerate(first or []):
        x = (x or "").strip().lstrip("﻿") or f"column_{i + 1}"
        seen[x] = seen.get(x, 0) + 1
        names.append(x if seen[x] == 1 else f"{x}_{seen[x]}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).option("multiLine", True).schema(schema).csv(path)


def present(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c))


def infer(cells: DataFrame, share: float = 0.8) -> dict[str, str]:
    """date, number or text for each column: a kind counts if that share of the filled cells has it, dates first. One aggregate for all columns."""
    parts = []
    for i, n in enumerate(cells.columns):
        v = present(F.col(f"`{n}`"))
        parts += [F.avg(F.when(v.isNotNull(), parse_date(v).isNotNull().cast("int"))).alias(f"d{i}"), F.avg(F.when(v.isNotNull(), v.rlike(NUMBER).cast("int"))).alias(f"n{i}")]
    r = cells.agg(*parts).first()
    kinds = {}
    for i, n in enumerate(cells.columns):
        date, number = r[f"d{i}"] or 0, r[f"n{i}"] or 0
        years = "year" in n.lower()
        kinds[n] = "date" if date >= share and (number < share or years) else "number" if number >= share else "text"
    return kinds


def build_table(cells: DataFrame) -> DataFrame:
    """Typed columns: doubles, dates and strings; what doesn't fit its column is null."""
    kinds = infer(cells)
    typed = {"number": lambda v: F.when(v.rlike(NUMBER), v.try_cast("double")), "date": parse_date, "text": lambda v: v}
    return cells.select(*[typed[k](present(F.col(f"`{n}`"))).alias(n) for n, k in kinds.items()])


def _named(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    low = {c.strip().lower(): c for c in columns}
    return next((low[w] for w in wanted if w in low), None)


def coordinates(cells: DataFrame) -> DataFrame:
    """lon, lat, elevation and valid (finite, in range) of each row."""
    lat, lon, z = (_named(cells.columns, w) for w in (LATITUDE, LONGITUDE, ELEVATION))
    if lat is None or lon is None:
        raise ValueError("no columns of latitude and longitude")
    x = cells.select(F.col(lon).try_cast("double").alias("lon"), F.col(lat).try_cast("double").alias("lat"), (F.col(z).try_cast("double") if z else F.lit(None).cast("double")).alias("elevation"))
    return x.withColumn("valid", F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False)))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature, type, name-value properties and coordinates (JSON) of a collection, a feature or a bare geometry."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("j"))
    get = lambda c, p, t: F.try_variant_get(c, p, t)
    features = whole.select(F.coalesce(get("j", "$.features", "array<variant>"), F.array("j")).alias("f"), get("j", "$.crs.properties.name", "string").alias("crs")).select("crs", F.posexplode("f").alias("feature", "v"))
    geometry = F.coalesce(get("v", "$.geometry", "variant"), F.col("v"))
    return features.select("feature", get("v", "$.properties", "map<string, string>").alias("properties"), get(geometry, "$.type", "string").alias("type"), F.to_json(get(geometry, "$.coordinates", "variant")).alias("coordinates"), "crs")


def points_of(text: Column) -> Column:
    """lon,lat[,z] tuples of KML as an array of structs."""
    tuples = F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != "")
    return F.transform(tuples, lambda s: F.struct(F.get(F.split(s, ","), 0).try_cast("double").alias("x"), F.get(F.split(s, ","), 1).try_cast("double").alias("y"), F.get(F.split(s, ","), 2).try_cast("double").alias("z")))


def kml(spark: SparkSession, path: str) -> DataFrame:
    """name, kind and points of each placemark's outer ring, line or point."""
    ring = "struct<LinearRing: struct<coordinates: string>>"
    schema = f"name string, Polygon struct<outerBoundaryIs: {ring}>, LineString struct<coordinates: string>, Point struct<coordinates: string>"
    x = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    outer = F.col("Polygon.outerBoundaryIs.LinearRing.coordinates")
    kind = F.when(outer.isNotNull(), "Polygon").when(F.col("LineString.coordinates").isNotNull(), "LineString").otherwise("Point")
    return x.select("name", kind.alias("kind"), points_of(F.coalesce(outer, "LineString.coordinates", "Point.coordinates")).alias("points"))


def gpx_tracks(spark: SparkSession, path: str) -> DataFrame:
    """segment, i, lon, lat and elevation of the tracks' points."""
    x = spark.read.format("xml").option("rowTag", "trkseg").schema("trkpt array<struct<_lat: double, _lon: double, ele: double>>").load(path)
    x = x.withColumn("segment", F.monotonically_increasing_id())
    return x.select("segment", F.posexplode("trkpt").alias("i", "p")).select("segment", "i", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), F.col("p.ele").alias("elevation"))


def daily_weather(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """One row a day from an answer whose `daily` holds parallel arrays."""
    schema = "daily struct<time: array<string>, " + ", ".join(f"`{v}`: array<double>" for v in variables) + ">"
    x = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = x.select(F.explode(F.arrays_zip("daily.time", *[f"daily.{v}" for v in variables])).alias("r"))
    return rows.select(F.col("r.time").cast("date").alias("d"), *[F.col(f"r.{v}").alias(v) for v in variables])


def daily_power(spark: SparkSession, path: str, variables: list[str], fill: float = -999.0) -> DataFrame:
    """One row a day from an answer that maps each variable to days (yyyymmdd); the fill value is missing."""
    x = spark.read.schema("properties struct<parameter: map<string, map<string, double>>>").option("multiLine", True).json(path)
    rows = x.select(F.explode("properties.parameter").alias("variable", "days")).select("variable", F.explode("days").alias("day", "v"))
    rows = rows.select(F.try_to_date("day", "yyyyMMdd").alias("d"), "variable", F.nullif("v", F.lit(fill)).alias("v"))
    return rows.groupBy("d").pivot("variable", variables).agg(F.first("v"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Tree rows below the header line that names a diameter or a girth; girths become diameters; rows end at a line of dashes."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    head = lines.where(F.lower("line").rlike(r"(^|,)\s*(dbh|gbh|diameter|girth)")).agg(F.min("i").alias("top"), F.min_by("line", "i").alias("names"))
    stop = lines.crossJoin(F.broadcast(head)).where((F.col("i") > F.col("top")) & F.col("line").startswith("---")).agg(F.coalesce(F.min("i"), F.lit(1 << 30)).alias("stop"))
    rows = lines.crossJoin(F.broadcast(head)).crossJoin(F.broadcast(stop)).where("i > top and i < stop and trim(line) <> ''")
    names = F.transform(F.split("names", ","), lambda n: F.lower(F.trim(n)))
    cell = F.map_from_arrays(names, F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.nullif(F.trim(F.get(F.split("line", ","), k)), F.lit(""))))
    rows = rows.select("i", cell.alias("c"))
    num = lambda *k: F.coalesce(*[F.replace(F.try_element_at("c", F.lit(n)), F.lit(","), F.lit(".")).try_cast("double") for n in k])
    text = lambda *k: F.coalesce(*[F.try_element_at("c", F.lit(n)) for n in k])
    return rows.select("i", text("plot", "plot_id").alias("plot"), text("species", "name").alias("species"), F.coalesce(num("dbh", "diameter"), num("gbh", "girth") / F.pi()).alias("dbh"), num("height", "h").alias("height"), text("status").alias("status"))
