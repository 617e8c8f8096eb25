"""Queries over canopy heights, sampled accuracy and photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import classes
from fieldloom.operators import assessment, canopy, photos
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins

HEIGHTS = f"{standins.GRID}, canopy AS (SELECT row, col, (z + 0.5) * 20 AS h, 1 + row * 0.001 AS a FROM grid)"


def _area() -> Column:
    return 1 + F.col("row") * 0.001


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.grid(spark, sf_dir).withColumn("h", (F.col("z") + 0.5) * 20)


@query(f"""
WITH {HEIGHTS} SELECT round(CAST(sum(a) AS DOUBLE), 4) AS area, round(CAST(sum(CASE WHEN h >= 9 THEN a ELSE 0 END) / sum(a) AS DOUBLE), 6) AS cover, round(CAST(sum(CASE WHEN h >= 5 THEN a ELSE 0 END) / sum(a) AS DOUBLE), 6) AS forest_cover,
round(avg(h) FILTER (WHERE h >= 9), 6) AS mean, round(max(h), 6) AS max, round(quantile_cont(h, 0.25) FILTER (WHERE h >= 9), 6) AS q1, round(quantile_cont(h, 0.5) FILTER (WHERE h >= 9), 6) AS median,
round(quantile_cont(h, 0.75) FILTER (WHERE h >= 9), 6) AS q3, round(quantile_cont(h, 0.95) FILTER (WHERE h >= 9), 6) AS p95 FROM canopy""")
def canopy_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover at two heights, and heights of the canopy cells (from 9 m, so that some are below)."""
    x = canopy.canopy_statistics(_heights(spark, sf_dir), "h", _area(), 9.0)
    return x.select(F.round("area", 4).alias("area"), *[F.round(c, 6).alias(c) for c in x.columns[1:]])


@query(f"WITH {HEIGHTS} SELECT {classes.ladder_sql('h', classes.CANOPY_HEIGHT)} AS class, round(CAST(sum(a) AS DOUBLE), 4) AS area FROM canopy WHERE h >= 0 GROUP BY ALL")
def canopy_height_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canopy.area_by_height(_heights(spark, sf_dir), "h", _area()).select("class", F.round("area", 4).alias("area"))


@query("""
WITH p AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_extendedprice AS z, l_linenumber = 1 AS first, l_returnflag = 'R' AS ground FROM lineitem)
SELECT CAST(least(floor((10 - y) / 2.5), 3) AS INT) AS row, CAST(least(floor((x - 1) / 2.5), 17) AS INT) AS col, max(CASE WHEN first THEN z END) AS highest, min(CASE WHEN ground THEN z END) AS lowest
FROM p WHERE x >= 1 AND x <= 1 + 18 * 2.5 AND y <= 10 AND y >= 0 GROUP BY ALL""")
def gridded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest first return and the lowest ground return of each cell of a point cloud."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("z"), "l_linenumber", "l_returnflag")
    return canopy.gridded_extremes(p, 1.0, 10.0, 2.5, 18, 4, F.col("l_linenumber") == 1, F.col("l_returnflag") == "R")


@query(f"WITH {standins.TREES} SELECT plot, species, dbh, round(height, 6) AS height FROM trees ORDER BY trees.height DESC, plot, species, dbh LIMIT 500")
def tallest_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 tallest trees, for a map."""
    return canopy.tallest(standins.trees(spark, sf_dir), "height", ["plot", "species", "dbh"], 500).select("plot", "species", "dbh", F.round("height", 6).alias("height"))


@query(f"""WITH {standins.TREES}, d AS (SELECT * FROM (VALUES ('Brand#1', 0.41), ('Brand#5', 0.52), ('Brand#13', 0.66)) t(species, density))
SELECT species, count(*) AS trees, round(CAST(avg(coalesce(density, 0.57)) AS DOUBLE), 6) AS density FROM trees LEFT JOIN d USING (species) GROUP BY species""")
def wood_density_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wood density by species, or the default for species that aren't listed."""
    d = spark.createDataFrame([("Brand#1", 0.41), ("Brand#5", 0.52), ("Brand#13", 0.66)], "species string, density double")
    return canopy.with_density(standins.trees(spark, sf_dir), "species", d, 0.57).groupBy("species").agg(F.count("*").alias("trees"), F.round(F.avg("density"), 6).alias("density"))


SAMPLE = """m AS (SELECT l_returnflag AS mapped, CASE WHEN l_partkey % 9 = 0 THEN 'R' WHEN l_partkey % 7 = 0 THEN 'N' ELSE l_returnflag END AS reference, count(*) AS n FROM lineitem GROUP BY ALL),
areas AS (SELECT * FROM (VALUES ('A', 300.0::DOUBLE), ('N', 500.0::DOUBLE), ('R', 200.0::DOUBLE)) t(mapped, area)), r AS (SELECT mapped, sum(n) AS ni FROM m GROUP BY mapped),
c AS (SELECT m.mapped, reference, area / 1000 AS w, area, ni, n / ni AS f FROM m JOIN r USING (mapped) JOIN areas USING (mapped)), u AS (SELECT mapped AS class, area, ni, f AS u, f * (1 - f) / (ni - 1) AS vu FROM c WHERE mapped = reference)"""


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    reference = F.when(k % 9 == 0, "R").when(k % 7 == 0, "N").otherwise(F.col("l_returnflag"))
    matrix = x.groupBy(F.col("l_returnflag").alias("mapped"), reference.alias("reference")).agg(F.count("*").alias("n"))
    return matrix, spark.createDataFrame([("A", 300.0), ("N", 500.0), ("R", 200.0)], "mapped string, area double")


@query(f"""
WITH {SAMPLE}, p AS (SELECT reference AS class, sum(w * f) AS share, sum(w * w * f * (1 - f) / (ni - 1)) AS v, sum(area * f) AS est, sum(CASE WHEN mapped <> reference THEN area * area * f * (1 - f) / (ni - 1) ELSE 0 END) AS others, sum(CASE WHEN mapped = reference THEN w * f ELSE 0 END) AS hit FROM c GROUP BY reference)
SELECT class, CAST(ni AS BIGINT) AS samples, round(u, 6) AS user, round(1.959964 * sqrt(vu), 6) AS user_half, round(hit / share, 6) AS producer,
round(1.959964 * sqrt((area * area * (1 - hit / share) ** 2 * vu + (hit / share) ** 2 * others) / est ** 2), 6) AS producer_half, round(share * 1000, 6) AS area, round(1.959964 * sqrt(v) * 1000, 6) AS area_half FROM p JOIN u USING (class)""")
def class_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User's and producer's accuracy and area of each class with the half widths of 95 % intervals."""
    x = assessment.accuracies(*_sample(spark, sf_dir))
    return x.select("class", "samples", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


@query(f"WITH {SAMPLE} SELECT CAST(sum(ni) AS BIGINT) AS samples, round(sum(area / 1000 * u), 6) AS overall, round(1.959964 * sqrt(sum((area / 1000) ** 2 * vu)), 6) AS half FROM u")
def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = assessment.overall(*_sample(spark, sf_dir))
    return x.select("samples", F.round("overall", 6).alias("overall"), F.round("half", 6).alias("half"))


@query("WITH s AS (SELECT o_orderstatus, count(*) / (SELECT count(*) FROM orders) AS w FROM orders GROUP BY ALL) SELECT CAST(ceil((round(sum(w), 9) * sqrt(0.8 * 0.2) / 0.01) ** 2 - 1e-6) AS BIGINT) AS size FROM s")
def validation_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a validation sample for a standard error of 0.01. Weights of strata are sums of shares, rounded against the last bit."""
    o = table(spark, sf_dir, "orders")
    n = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    w = n.crossJoin(F.broadcast(o.agg(F.count("*").alias("whole")))).agg(F.round(F.sum(F.col("n") / F.col("whole")), 9).alias("w"))
    return w.agg(assessment.cochran(F.col("w")).cast("long").alias("size"))


@query("""
WITH points AS (SELECT o_orderkey AS id, o_orderkey % 3 + 1 AS mapped FROM orders), labels AS (SELECT o_orderkey AS id, list_value('Forest', ' water', '3', 'bog', '')[1 + o_custkey % 5] AS label FROM orders WHERE o_orderkey % 4 <> 0),
j AS (SELECT p.mapped, CASE lower(trim(label)) WHEN 'forest' THEN 1 WHEN '1' THEN 1 WHEN 'water' THEN 2 WHEN '2' THEN 2 WHEN 'bare' THEN 3 WHEN '3' THEN 3 END AS reference, label FROM points p LEFT JOIN labels l USING (id))
SELECT CAST(mapped AS INT) AS mapped, CAST(reference AS INT) AS reference, (reference IS NULL AND coalesce(trim(label), '') <> '') AS unknown, count(*) AS n FROM j GROUP BY ALL""")
def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample points with the classes that people gave them by name or number; unknown names and missing labels are counted."""
    o = table(spark, sf_dir, "orders")
    points = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("mapped"))
    given = F.array(*[F.lit(s) for s in ("Forest", " water", "3", "bog", "")])
    labels = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.get(given, (F.col("o_custkey") % 5).cast("int")).alias("label"))
    names = spark.createDataFrame([(1, "forest"), (2, "Water"), (3, "bare")], "class int, name string")
    return assessment.labelled(points, labels, names).groupBy("mapped", "reference", "unknown").agg(F.count("*").alias("n"))


PIXELS = "pixel AS (SELECT l_linestatus AS photo, l_partkey % 256 AS r, (l_partkey * 7 + l_suppkey) % 256 AS g, l_orderkey % 256 AS b, CAST(l_quantity * 6 AS INT) AS alpha FROM lineitem)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("photo"), (k % 256).alias("red"), ((k * 7 + F.col("l_suppkey")) % 256).alias("green"), (F.col("l_orderkey") % 256).alias("blue"), (F.col("l_quantity") * 6).cast("int").alias("alpha"))


@query(f"""
WITH {PIXELS}, o AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS luma, CASE WHEN r + g + b > 0 THEN (2 * g - r - b) / (r + g + b) ELSE 0 END AS exg, CASE WHEN abs(g + r - b) >= 1 THEN (g - r) / (g + r - b) END AS v FROM pixel WHERE alpha >= 128)
SELECT photo, count(*) AS pixels, round(avg(r), 6) AS red, round(avg(g), 6) AS green, round(avg(b), 6) AS blue, round(avg(CAST(luma AS DOUBLE)), 6) AS luma, round(avg(CASE WHEN v >= -1 AND v <= 1 THEN v END), 6) AS vari, round(avg(CASE WHEN exg > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS vegetation FROM o GROUP BY photo""")
def photo_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the channels, brightness and greenness of photos' visible pixels, and their share of vegetation."""
    x = photos.channel_statistics(_pixels(spark, sf_dir), 0.1, "photo")
    return x.select("photo", "pixels", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


PALETTE = [(0, 100, 0), (255, 187, 34), (240, 150, 255), (0, 100, 200), (180, 180, 180)]


@query(f"""
WITH {PIXELS}, k AS (SELECT * FROM (VALUES {", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE))}) t(i, x, y, z)), n AS (SELECT row_number() OVER () AS id, * FROM pixel),
d AS (SELECT id, arg_min(i, ((r - x) ** 2 + (g - y) ** 2 + (b - z) ** 2) * 10 + i) AS class FROM n, k GROUP BY id) SELECT class, count(*) AS n FROM d GROUP BY class""")
def nearest_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by the nearest of a map's colours."""
    c = photos.nearest_colour(F.col("red"), F.col("green"), F.col("blue"), PALETTE)
    return _pixels(spark, sf_dir).groupBy(c.alias("class")).agg(F.count("*").alias("n"))
