"""Queries that model one series for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators import series
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins


@query(f"""
WITH {standins.DAILY}, r AS (SELECT kind AS key, CAST(d - DATE '1970-01-01' AS DOUBLE) AS tm, value AS v FROM daily),
c AS (SELECT key, tm, tm - avg(tm) OVER (PARTITION BY key) AS t, v - avg(v) OVER (PARTITION BY key) AS y FROM r),
s AS (SELECT *, count(*) OVER e AS n, sum(t * t) OVER e AS tt, sum(t * y) OVER e AS ty, sum(y * y) OVER e AS yy, count(*) OVER u AS k, sum(t) OVER u AS t0, sum(y) OVER u AS y0, lead(tm) OVER (PARTITION BY key ORDER BY tm, y) AS next
  FROM c WINDOW e AS (PARTITION BY key), u AS (PARTITION BY key ORDER BY tm, y ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, greatest(yy - ty * ty / tt, 1e-10 * n) AS rss0, (n - k) - (n - k) * (n - k) / CAST(n AS DOUBLE) - t0 * t0 / tt AS ss, -y0 + ty / tt * t0 AS sr FROM s WHERE n >= 5 AND k >= 2 AND n - k >= 2),
g AS (SELECT *, sr / ss AS shift, greatest(yy - ty * ty / tt - sr * sr / ss, 1e-10 * n) AS rss1 FROM f WHERE ss > 1e-9),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(rss1, 9), k) AS place FROM g)
SELECT key AS kind, n, k, before, after, round(shift, 6) AS shift, disturbed FROM (SELECT key, n, k, tm AS before, next AS after, shift,
(n * ln(rss1 / n) + 4 * ln(n) < n * ln(rss0 / n) + 2 * ln(n)) AND shift <= -1 AS disturbed FROM b WHERE place = 1)""")
def single_break_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = standins.daily(spark, sf_dir).withColumn("t", F.unix_date("d"))
    return series.single_break(x, "kind", "t", "value", 1.0).withColumn("shift", F.round("shift", 6))


@query(f"""
WITH {standins.DAILY}, b AS (SELECT kind, d, value < 50 AS bad FROM daily),
i AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY d) - row_number() OVER (PARTITION BY kind, bad ORDER BY d) AS island FROM b)
SELECT kind, min(d) AS first, max(d) AS last, count(*) AS length FROM i WHERE bad GROUP BY kind, island HAVING count(*) >= 2""")
def consecutive_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or more consecutive low days of a kind."""
    x = standins.daily(spark, sf_dir).withColumn("bad", F.col("value") < 50)
    return series.runs_of_anomalies(x, "kind", "d", "bad", 2)


@query(f"""
WITH {standins.DAILY}, f AS (SELECT *, CASE WHEN value >= 45 THEN value END AS seen FROM daily)
SELECT kind, d, round(last_value(seen IGNORE NULLS) OVER (PARTITION BY kind ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS before,
round(first_value(seen IGNORE NULLS) OVER (PARTITION BY kind ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 6) AS after FROM f""")
def as_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid value before each day and the first after it."""
    x = standins.daily(spark, sf_dir).withColumn("seen", F.when(F.col("value") >= 45, F.col("value")))
    w = W.partitionBy("kind").orderBy("d")
    before, after = F.last("seen", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first("seen", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return x.select("kind", "d", F.round(before, 6).alias("before"), F.round(after, 6).alias("after"))


@query()
def ascent_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascent and descent along each grid row with a threshold; a fold that SQL windows can't express."""
    x = series.ascent(standins.grid(spark, sf_dir), "row", "col", "z", 0.1)
    return x.select("row", F.round("ascent", 6).alias("ascent"), F.round("descent", 6).alias("descent"))


@query()
def seasonal_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of each supplier's monthly revenue under a yearly harmonic; a sequential fit."""
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"), "l_extendedprice")
    x = x.groupBy("l_suppkey", (F.year("d") + (F.month("d") - 1) / 12).alias("t")).agg(F.sum("l_extendedprice").alias("value"))
    return series.seasonal_monitor(x, "l_suppkey", "t", "value", drop=50_000.0)
