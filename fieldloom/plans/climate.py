"""Queries over monthly and daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.classes import spi_class
from fieldloom.operators import climate
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins


@query("""
SELECT event_type, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, round(avg(value), 6) AS mean, count(*) AS n,
round(count(DISTINCT CAST(ts AS DATE)) / CAST(day(last_day(CAST(min(ts) AS DATE))) AS DOUBLE), 6) AS coverage
FROM events GROUP BY event_type, year(ts), month(ts)""")
def monthly_mean_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("d"), "value")
    return climate.monthly_means(e, "d", "value", "event_type").select("event_type", "y", "m", F.round("mean", 6).alias("mean"), "n", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {standins.MONTHLY} SELECT m, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(*) AS years FROM monthly GROUP BY m")
def seasonal_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = climate.climatology(standins.monthly(spark, sf_dir), "value")
    return x.select("m", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "years")


@query(f"""
WITH {standins.MONTHLY}, a AS (SELECT t, value - avg(value) OVER (PARTITION BY m) AS anomaly, stddev_samp(value) OVER (PARTITION BY m) AS sd FROM monthly)
SELECT t, round(anomaly, 4) AS anomaly, round(CASE WHEN sd > 0 THEN anomaly / sd END, 6) AS z FROM a""")
def monthly_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.anomalies(standins.monthly(spark, sf_dir), "value").select("t", F.round("anomaly", 4).alias("anomaly"), F.round("z", 6).alias("z"))


@query(f"""
WITH {standins.MONTHLY}, e AS (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM monthly), x AS (SELECT e.t, value AS v FROM e LEFT JOIN monthly ON monthly.t = e.t)
SELECT CAST(t AS INT) AS t, round(CASE WHEN count(v) OVER w = 6 THEN sum(v) OVER w END, 2) AS total FROM x WINDOW w AS (ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def rolling_six_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.rolling_total(standins.monthly(spark, sf_dir), "value", 6).select("t", F.round("total", 2).alias("total"))


@query(f"""
WITH {standins.DAILY}, b AS (SELECT kind, sum(value) AS total, count(*) FILTER (value >= 60) AS rainy_days, max(value) AS wettest, max(d) - min(d) + 1 - count(DISTINCT d) AS missing_days FROM daily GROUP BY kind),
w AS (SELECT kind, d AS wettest_day FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, d) AS k FROM daily) WHERE k = 1),
r AS (SELECT kind, d - CAST(row_number() OVER (PARTITION BY kind ORDER BY d) AS INT) AS run FROM daily WHERE value < 60),
s AS (SELECT kind, max(n) AS dry_spell FROM (SELECT kind, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY kind)
SELECT b.kind, round(total, 6) AS total, rainy_days, round(wettest, 6) AS wettest, wettest_day, missing_days, coalesce(dry_spell, 0) AS dry_spell FROM b JOIN w ON b.kind = w.kind LEFT JOIN s ON b.kind = s.kind""")
def rain_indices_dry_spell(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = climate.rain_indices(standins.daily(spark, sf_dir), "d", "value", "kind", rainy=60.0)
    return x.select("kind", F.round("total", 6).alias("total"), "rainy_days", F.round("wettest", 6).alias("wettest"), "wettest_day", "missing_days", "dry_spell")


@query(f"""
WITH {standins.MONTHLY}, x AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY y) AS i FROM monthly),
p AS (SELECT sum(sign(b.value - a.value)) AS s, quantile_cont((b.value - a.value) / (b.y - a.y), 0.5) AS slope FROM x a JOIN x b ON a.m = b.m AND a.i < b.i),
v AS (SELECT sum(n) AS n, sum(n * (n - 1) * (2 * n + 5)) / 18.0 AS variance FROM (SELECT m, count(*) AS n FROM monthly GROUP BY m HAVING count(*) >= 2))
SELECT CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, round(CAST(variance AS DOUBLE), 4) AS variance, round(CAST((s - sign(s)) / sqrt(variance) AS DOUBLE), 6) AS z, round(slope, 4) AS slope FROM p, v""")
def seasonal_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = climate.seasonal_kendall(standins.monthly(spark, sf_dir), "value")
    return x.select("n", "s", F.round("variance", 4).alias("variance"), F.round("z", 6).alias("z"), F.round("slope", 4).alias("slope"))


@query(f"""
WITH {standins.MONTHLY}, f AS (SELECT m, avg(CASE WHEN value <= 0 THEN 1.0 ELSE 0.0 END) AS q, avg(value) AS mean, avg(ln(value)) AS log_mean FROM monthly GROUP BY m),
a AS (SELECT *, ln(mean) - log_mean AS a FROM f)
SELECT m, round(q, 6) AS q, round((1 + sqrt(1 + 4 * a / 3)) / (4 * a), 4) AS alpha, round(mean / ((1 + sqrt(1 + 4 * a / 3)) / (4 * a)), 2) AS beta FROM a""")
def gamma_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the gamma distributions behind the precipitation index."""
    return climate.gamma_fit(standins.monthly(spark, sf_dir), "value").select("m", F.round("q", 6).alias("q"), F.round("alpha", 4).alias("alpha"), F.round("beta", 2).alias("beta"))


@query()
def precipitation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index over 3 months and its classes; the incomplete gamma function has no SQL form."""
    x = climate.spi(standins.monthly(spark, sf_dir), "value", 3)
    return x.select("t", F.round("total", 2).alias("total"), F.round("spi", 6).alias("spi"), spi_class(F.col("spi")).alias("class"))
