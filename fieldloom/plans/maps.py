"""Queries that regrid, relabel and render."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import classes, solar
from fieldloom.operators import regrid, stats
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins

TARGET = "t AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT unnest(range(200)) AS r), (SELECT unnest(range(40)) AS c))"


@query(f"WITH {standins.GRID}, {TARGET} SELECT t.row, t.col, z FROM t LEFT JOIN grid g ON g.row = floor((t.row + 0.5) * 2.5) AND g.col = floor((t.col + 0.5) * 1.6)")
def regrid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.nearest(regrid.target_cells(spark, 200, 40), standins.grid(spark, sf_dir), "z", 2.5, 1.6)


@query(f"""
WITH {standins.GRID}, {TARGET}, p AS (SELECT row, col, CAST((row + 0.5) * 2.5 - 0.5 AS DOUBLE) AS y, CAST((col + 0.5) * 1.6 - 0.5 AS DOUBLE) AS x FROM t),
k AS (SELECT p.row, p.col, floor(y) + i AS r, floor(x) + j AS c, CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END * CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) n(i, j))
SELECT k.row, k.col, round(sum(w * z) / sum(w), 6) AS z FROM k JOIN grid g ON g.row = k.r AND g.col = k.c WHERE w > 0 GROUP BY k.row, k.col""")
def regrid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.bilinear(regrid.target_cells(spark, 200, 40), standins.grid(spark, sf_dir), "z", 2.5, 1.6).withColumn("z", F.round("z", 6))


@query("""
WITH m AS (SELECT label, avg(list_aggregate(embedding[1:3], 'avg')) AS m, count(*) AS n FROM embeddings GROUP BY label)
SELECT CAST(label AS INT) AS label, CAST(row_number() OVER (ORDER BY m, label) AS INT) AS class, n FROM m""")
def relabel_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters renumbered by the rank of a band mean."""
    mean = F.aggregate(F.slice("embedding", 1, 3), F.lit(0.0), lambda a, x: a + x.cast("double")) / 3
    m = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg(mean).alias("m"), F.count("*").alias("n"))
    return m.select("label", F.row_number().over(W.orderBy("m", "label")).alias("class"), "n")


@query(f"WITH {standins.GRID}, s AS (SELECT col, quantile_cont(z, 0.02) AS low, quantile_cont(z, 0.98) AS high FROM grid GROUP BY col) SELECT g.row, g.col, CAST(round_even(greatest(0, least(1, (z - low) / (high - low))) * 255, 0) AS INT) AS shade FROM grid g JOIN s ON s.col = g.col")
def stretched_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each channel stretched between its 2nd and 98th percentiles to bytes."""
    g = standins.grid(spark, sf_dir)
    s = stats.quantiles(g, "z", [0.02, 0.98], "col").withColumnRenamed("q", "p")
    part = (F.col("z") - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0])
    return g.join(s, "col").select("row", "col", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * 255).cast("int").alias("shade"))


@query("SELECT CASE WHEN k >= 9 THEN 'G5' WHEN k >= 8 THEN 'G4' WHEN k >= 7 THEN 'G3' WHEN k >= 6 THEN 'G2' WHEN k >= 5 THEN 'G1' WHEN k >= 4 THEN 'active' WHEN k >= 3 THEN 'unsettled' ELSE 'quiet' END AS label, count(*) AS n FROM (SELECT (event_id % 28) / 3.0 AS k FROM events) GROUP BY ALL")
def storm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("event_id") % 28) / 3
    return table(spark, sf_dir, "events").groupBy(classes.kp_label(k).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_type, 'requests_total{kind=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters as lines of a monitoring page."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.format_string('requests_total{kind="%s"} %d', "event_type", "n").alias("line"))


G = "2 * pi() / 365 * (day - 1)"
DEC = f"(0.006918 - 0.399912 * cos({G}) + 0.070257 * sin({G}) - 0.006758 * cos(2 * {G}) + 0.000907 * sin(2 * {G}) - 0.002697 * cos(3 * {G}) + 0.00148 * sin(3 * {G}))"


@query(f"""
WITH d AS (SELECT DISTINCT CAST(dayofyear(o_orderdate) AS INT) AS day FROM orders), x AS (SELECT day, (cos(radians(CAST(90.833 AS DOUBLE))) - sin(radians(60)) * sin({DEC})) / (cos(radians(60)) * cos({DEC})) AS x FROM d)
SELECT day, round(CASE WHEN x >= 1 THEN 0 WHEN x <= -1 THEN 1440 ELSE 8 * degrees(acos(x)) END, 4) AS minutes FROM x""")
def day_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of daylight at 60 degrees north for each day of the year."""
    d = table(spark, sf_dir, "orders").select(F.dayofyear(F.col("o_orderdate").cast("date")).alias("day")).distinct()
    return d.select("day", F.round(solar.day_length(F.lit(60.0), F.col("day")), 4).alias("minutes"))
