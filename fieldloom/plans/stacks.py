"""Queries over stacks of dated images and over patches of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import cells, networks, stacks
from fieldloom.plans.networks import HIGH, WIDTH
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins

IMAGES = """image AS (SELECT CAST(ts AS DATE) AS date, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS v FROM events),
shown AS (SELECT date, avg(v) AS mean, quantile_cont(v, 0.5) AS median, count(v) / count(*) AS valid, count(v) / count(*) < 0.2 AS sparse FROM image GROUP BY date)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an image a day; two kinds of events are cloud."""
    e = table(spark, sf_dir, "events")
    x = e.select(F.col("ts").cast("date").alias("date"), F.when(~F.col("event_type").isin("error", "signup"), F.col("value")).alias("v"))
    return stacks.image_rows(x, "date", "v")


@query(f"WITH {IMAGES} SELECT date, round(mean, 6) AS mean, round(median, 6) AS median, round(valid, 6) AS valid, sparse FROM shown")
def stack_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and share of valid cells of each image, sparse ones marked."""
    return _images(spark, sf_dir).select("date", *[F.round(c, 6).alias(c) for c in ("mean", "median", "valid")], "sparse")


@query(f"""
WITH {IMAGES}, x AS (SELECT year(date) + (dayofyear(date) - 1) / (make_date(year(date) + 1, 1, 1) - make_date(year(date), 1, 1)) AS t, mean AS y, row_number() OVER (ORDER BY date) AS i FROM shown WHERE NOT sparse AND mean IS NOT NULL),
p AS (SELECT a.y AS ay, b.y AS yb, a.t AS ta, b.t AS tb FROM x a JOIN x b ON a.i < b.i),
s AS (SELECT CAST(sum(sign(yb - ay)) AS BIGINT) AS s, quantile_cont((yb - ay) / (tb - ta), 0.5) AS sen FROM p),
n AS (SELECT count(*) AS n FROM x), tie AS (SELECT sum(m * (m - 1) * (2 * m + 5)) AS ties FROM (SELECT count(*) AS m FROM x GROUP BY y)),
v AS (SELECT n, s, sen, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS variance FROM s, n, tie)
SELECT n, s, round(sen, 4) AS sen, round(CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(variance) END, 6) AS z FROM v WHERE n >= 4""")
def stack_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of the images' means over decimal years."""
    return stacks.stack_trend(_images(spark, sf_dir), "date").select("n", "s", F.round("sen", 4).alias("sen"), F.round("z", 6).alias("z"))


BREAKS = "breaks AS (SELECT o_custkey AS cell, CAST(year(o_orderdate) AS INT) AS seen, 0.1 * (o_custkey % 7 + 1) AS area FROM orders WHERE o_orderstatus = 'F')"


def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_custkey").alias("cell"), F.year("o_orderdate").alias("seen"), (F.lit(0.1) * (F.col("o_custkey") % 7 + 1)).alias("area"))


@query(f"WITH {BREAKS} SELECT cell, count(*) AS disturbances, min(seen) AS first, max(seen) AS latest FROM breaks GROUP BY cell")
def first_and_latest_disturbance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacks.first_and_latest(_breaks(spark, sf_dir), "seen", "cell")


@query(f"""
WITH {BREAKS}, d AS (SELECT cell, seen, CAST(max(area) AS DOUBLE) AS a FROM breaks GROUP BY ALL), f AS (SELECT cell, min(seen) AS date, max(a) AS a FROM d GROUP BY cell),
n AS (SELECT date, count(*) AS first_cells, sum(a) AS first_area FROM f GROUP BY date), e AS (SELECT seen AS date, count(*) AS cells, sum(a) AS area FROM d GROUP BY seen)
SELECT e.date, cells, round(area, 6) AS area, coalesce(first_cells, 0) AS first_cells, round(coalesce(first_area, 0), 6) AS first_area FROM e LEFT JOIN n ON n.date = e.date""")
def disturbed_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and area disturbed in each year, at all and for the first time."""
    x = stacks.disturbed_by_date(_breaks(spark, sf_dir), "seen", "area", "cell")
    return x.select("date", "cells", F.round("area", 6).alias("area"), "first_cells", F.round("first_area", 6).alias("first_area"))


def _classed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = standins.grid(spark, sf_dir).withColumn("class", F.when(F.col("z") > 0.08, 2).otherwise(1))
    return g, networks.patches(g.where("class = 2"), WIDTH)


SMALL = HIGH + ", p AS (SELECT patch, count(*) AS n, sum(1 + row * 0.001) AS a FROM label JOIN x ON x.id = label.id GROUP BY patch)"


@query(SMALL + """, k AS (SELECT CASE WHEN z > 0.08 AND p.a >= 4 THEN 2 ELSE 1 END AS class, 1 + g.row * 0.001 AS area FROM grid g LEFT JOIN label l ON l.id = CAST(g.row AS BIGINT) * 64 + g.col LEFT JOIN p ON p.patch = l.patch)
SELECT CAST(class AS INT) AS class, count(*) AS cells, round(CAST(sum(area) AS DOUBLE), 6) AS area FROM k GROUP BY class""")
def classes_without_small_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of classes after patches below the minimum unit went to the other class."""
    g, p = _classed(spark, sf_dir)
    area = 1 + F.col("row") * 0.001
    x = stacks.without_small_patches(g, p, area, 4.0, "class", 1)
    return cells.class_totals(x, "class", area).select("class", "cells", F.round("area", 6).alias("area"))


@query(SMALL + """ SELECT CAST(count(*) FILTER (WHERE a < 4) AS BIGINT) AS removed_patches, CAST(coalesce(sum(n) FILTER (WHERE a < 4), 0) AS BIGINT) AS removed_cells,
round(CAST(coalesce(sum(a) FILTER (WHERE a < 4), 0) AS DOUBLE), 6) AS removed_area, count(*) FILTER (WHERE a >= 4) AS kept, round(CAST(coalesce(max(a) FILTER (WHERE a >= 4), 0) AS DOUBLE), 6) AS largest FROM p""")
def removed_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = _classed(spark, sf_dir)
    x = stacks.removal_report(p, 1 + F.col("row") * 0.001, 4.0)
    return x.select("removed_patches", "removed_cells", F.round("removed_area", 6).alias("removed_area"), "kept", F.round("largest", 6).alias("largest"))
