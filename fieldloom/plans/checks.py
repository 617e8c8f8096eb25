"""Queries that check values and choose rows: ranges, codes, order, budgets, outlets, clear scenes, retention, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import metrics
from fieldloom.operators import checks, stats
from fieldloom.plans.registry import query, table
from fieldloom.sinks import files
from fieldloom.sources import standins


@query(f"WITH {standins.GRID} SELECT round(avg(CASE WHEN abs(z) > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS outside, (SELECT bool_and(user_id BETWEEN 0 AND 60) FROM events) AS codes, (SELECT bool_and(value = floor(value)) FROM events) AS whole FROM grid")
def value_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an index outside its range, and whether codes are whole numbers in theirs."""
    e = table(spark, sf_dir, "events").agg(checks.all_codes(F.col("user_id"), 60).alias("codes"), checks.all_codes(F.col("value"), 10**9).alias("whole"))
    return standins.grid(spark, sf_dir).agg(F.round(checks.share_outside(F.col("z"), -0.2, 0.2), 6).alias("outside")).crossJoin(F.broadcast(e))


@query("""
WITH b AS (SELECT o_custkey, o_orderdate AS t, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT o_custkey, coalesce(bool_or(t < before), false) AS unordered FROM b GROUP BY o_custkey""")
def out_of_order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a series' times go back in the order of its file."""
    return checks.out_of_order(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", "o_custkey")


@query("""
WITH x AS (SELECT p_size % 7 + 1 AS strahler, count(*) AS lines, sum(p_size) AS points FROM part GROUP BY ALL), t AS (SELECT *, sum(points) OVER (ORDER BY strahler DESC) AS total FROM x)
SELECT CAST(strahler AS INT) AS strahler, lines, CAST(points AS BIGINT) AS points, CAST(total AS BIGINT) AS total FROM t WHERE total <= (SELECT sum(p_size) * 0.6 FROM part)""")
def stream_orders_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest whole stream orders that fit a budget of points."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 7 + 1).alias("strahler"), "p_size")
    budget = int(p.agg(F.sum("p_size") * 0.6).first()[0])
    return checks.orders_within(p, "strahler", "p_size", budget)


@query(f"WITH {standins.GRID} SELECT row, col, round(z, 6) AS z FROM grid WHERE abs(row - 40) <= 5 AND abs(col - 30) <= 5 ORDER BY grid.z DESC, row, col LIMIT 1")
def snapped_outlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of the greatest flow near a place."""
    return checks.nearest_best(standins.grid(spark, sf_dir), "z", 40, 30, 5).select("row", "col", F.round("z", 6).alias("z"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS cloud FROM events ORDER BY coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 100), ts, event_id LIMIT 6")
def clearest_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six scenes of least cloud, unknown cloud as 100."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("cloud"))
    return checks.clearest(e, "cloud", ["ts", "event_id"]).select("event_id", "cloud")


@query("WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, count(*) OVER () AS rows FROM orders) SELECT o_orderkey, position FROM x WHERE position % CAST(greatest(1, ceil(rows / 40)) AS BIGINT) = 0")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th row for a report of at most 40."""
    return checks.every_step(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 40).select("o_orderkey", "position")


@query(f"""
WITH {standins.GRID}, s AS (SELECT p_partkey AS number, p_partkey % 5 AS label, (p_partkey * 3) % 100 AS r, (p_partkey * 7) % 60 AS c, p_size % 5 + 1 AS reach FROM part)
SELECT row, col, arg_max(label, number) AS label FROM grid JOIN s ON row BETWEEN r AND r + reach AND col BETWEEN c AND c + reach GROUP BY row, col""")
def burnt_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of training shapes burnt into cells, the later shape over the earlier. The last shapes of each place and reach meet cells by the tiles of 8 cells that they touch."""
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(k.alias("number"), (k % 5).alias("label"), (k * 3 % 100).alias("r"), (k * 7 % 60).alias("c"), (F.col("p_size") % 5 + 1).alias("reach"))
    s = checks.last_of_place(s, ["r", "c", "reach"], "label")
    tiles = lambda a: F.explode(F.sequence(F.floor(a / 8), F.floor((a + F.col("reach")) / 8)))
    s = s.withColumn("tr", tiles(F.col("r"))).withColumn("tc", tiles(F.col("c")))
    g = standins.grid(spark, sf_dir)
    inside = (F.floor(F.col("row") / 8) == F.col("tr")) & (F.floor(F.col("col") / 8) == F.col("tc")) & F.col("row").between(F.col("r"), F.col("r") + F.col("reach")) & F.col("col").between(F.col("c"), F.col("c") + F.col("reach"))
    return checks.last_shape_wins(g, s, inside, "label")


@query(f"WITH {standins.GRID} SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(z), 6) AS z, count(z) AS cells FROM grid GROUP BY ALL")
def regrid_area_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finer map averaged onto a grid of cells four times as large."""
    return checks.regrid_mean(standins.grid(spark, sf_dir), "z", 4).select("row", "col", F.round("z", 6).alias("z"), "cells")


@query("SELECT event_type, count(*) AS n FROM events WHERE CASE event_type WHEN 'click' THEN ts >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY WHEN 'error' THEN ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY ELSE true END GROUP BY event_type")
def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are kept by the days of their kind."""
    x = checks.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-02-01").cast("timestamp"), "event_type", {"click": 7, "error": 20})
    return x.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN 2 ELSE 1 END AS kept FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def small_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a run without the long ones."""
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    return d.select("doc_id", F.size(checks.small_values(F.create_map(F.lit("text"), "text", F.lit("lang"), "lang"))).alias("kept"))


NAMES = ("NDVI_mean", "evi2", "LST_Day", "landSurfaceTemp", "rainfall mm", "ppt", "ET0", "evapotranspiration", "ssrd", "soilMoisture", "sm_surface", "RH 2m", "tempMax", "t2m", "depth")
KINDS = ("ndvi", "evi", "lst", "lst", "precip", "precip", "et", "et", "solar", "soilMoisture", "soilMoisture", "humidity", "airTemp", "airTemp", "generic")
FACTOR = "CASE WHEN metric IN ('ndvi', 'evi') THEN v / 10000 WHEN metric IN ('lst', 'airTemp') THEN v - 273.15 WHEN metric = 'soilMoisture' THEN v / 100 WHEN metric = 'et' THEN v / 8 ELSE v END"
LISTED = "list_value(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


@query(f"""
WITH x AS (SELECT {LISTED}[1 + o_orderkey % {len(KINDS)}] AS metric, 160 + o_totalprice / 1000 AS v FROM orders)
SELECT metric, count(*) AS n, round(avg({FACTOR}), 6) AS mean FROM x GROUP BY metric""")
def columns_in_class_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What columns measure, by their names, and their means in the units of the classes; records are 8 days apart."""
    names = F.array(*[F.lit(n) for n in NAMES])
    x = table(spark, sf_dir, "orders").select(metrics.metric(F.get(names, (F.col("o_orderkey") % len(NAMES)).cast("int"))).alias("metric"), (160 + F.col("o_totalprice") / 1000).alias("v"))
    medians = stats.quantiles(x, "v", [0.5], "metric").select("metric", F.col("q")[0].alias("median"))
    x = stats.with_keyed(x, medians, "metric").withColumn("v", metrics.in_class_units(F.col("metric"), F.col("v"), F.col("median"), F.lit(8.0)))
    return x.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("""
WITH x AS (SELECT event_type, value, ts, event_id FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS highest, arg_max(event_id, (value, -event_id)) AS highest_at, min(value) AS lowest, arg_min(event_id, (value, event_id)) AS lowest_at FROM x GROUP BY event_type""")
def column_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers over a column: how many, the mean, and where the highest and the lowest value stand, the first of equals."""
    return checks.answers(table(spark, sf_dir, "events"), "value", "event_id", "event_type")


@query("""
SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (user_id % 180) || ',' || (event_id % 90) || ']},"properties":{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}' AS value FROM events""")
def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features as GeoJSON, one a row."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 180).alias("lon"), (F.col("event_id") % 90).alias("lat"), "event_id", "event_type")
    return files.geojson_features(e, "lon", "lat", "event_id", "event_type")
