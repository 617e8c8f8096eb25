"""Queries over tables and series: statistics, histograms, classes, trends and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import classes
from fieldloom.operators import stats
from fieldloom.operators import tables as jobs
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def r6_sql(*columns: str, of: str = "") -> str:
    return ", ".join(f"round({of}{c}, 6) AS {c}" for c in columns)


SUMMARY = "count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3"


@query(f"SELECT {SUMMARY} FROM (SELECT l_extendedprice AS v FROM lineitem)")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stats.summary(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return x.select("n", *r6("mean", "sd"), "min", "max", *r6("q1", "median", "q3"))


@query(f"SELECT l_returnflag, l_linestatus, {SUMMARY} FROM (SELECT l_returnflag, l_linestatus, l_quantity AS v FROM lineitem) GROUP BY ALL")
def summary_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stats.summary(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus")
    return x.select("l_returnflag", "l_linestatus", "n", *r6("mean", "sd"), "min", "max", *r6("q1", "median", "q3"))


@query("""
WITH e AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem),
c AS (SELECT least(29, floor((l_extendedprice - low) / ((high - low) / 30))) AS bin, count(*) AS n FROM lineitem, e GROUP BY ALL)
SELECT CAST(b.bin AS INT) AS bin, round(low + b.bin * ((high - low) / 30), 6) AS lower, coalesce(c.n, 0) AS n
FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""")
def histogram_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 30).select("bin", F.round("lower", 6).alias("lower"), "n")


@query(f"""
WITH {standins.DAILY}, c AS (SELECT {classes.ladder_sql("value / 2", classes.RAIN)} AS class, count(*) AS n FROM daily GROUP BY ALL)
SELECT CAST(k.class AS INT) AS class, coalesce(n, 0) AS n FROM (SELECT unnest(range({len(classes.RAIN) + 1})) AS class) k LEFT JOIN c ON c.class = k.class""")
def value_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = standins.daily(spark, sf_dir).withColumn("half", F.col("value") / 2)
    return classes.class_counts(x, "half", classes.RAIN)


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY ALL)
SELECT e.event_type, CAST(CASE WHEN value < q1 THEN 0 WHEN value < q2 THEN 1 WHEN value < q3 THEN 2 ELSE 3 END AS INT) AS class, count(*) AS n
FROM events e JOIN q ON e.event_type = q.event_type GROUP BY ALL""")
def quartile_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by a kind's own quartiles, for columns without a known ladder."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    q = stats.summary(e, "value", "event_type").select("event_type", "q1", "median", "q3")
    v = F.col("value")
    at = F.when(v < F.col("q1"), 0).when(v < F.col("median"), 1).when(v < F.col("q3"), 2).otherwise(3)
    return e.join(q, "event_type").groupBy("event_type", at.cast("int").alias("class")).agg(F.count("*").alias("n"))


PAIRS = """pairs AS (SELECT a.y AS ay, b.y AS by_, a.t AS at_, b.t AS bt FROM x a JOIN x b ON a.i < b.i)"""

MONTHLY_TREND = f"""
WITH {standins.MONTHLY}, x AS (SELECT CAST(t AS DOUBLE) AS t, value AS y, row_number() OVER (ORDER BY t, value) AS i FROM monthly), {PAIRS},
s AS (SELECT sum(sign(by_ - ay)) AS s, quantile_cont(CASE WHEN bt <> at_ THEN (by_ - ay) / (bt - at_) END, 0.5) AS sen FROM pairs),
n AS (SELECT count(*) AS n, regr_slope(y, t) AS ols FROM x),
tie AS (SELECT sum(m * (m - 1) * (2 * m + 5)) AS ties FROM (SELECT count(*) AS m FROM x GROUP BY y)),
v AS (SELECT n, CAST(s AS BIGINT) AS s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS variance, sen, ols FROM s, n, tie),
z AS (SELECT *, CASE WHEN s = 0 OR variance <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(variance) END AS z FROM v)
SELECT n, s, round(CAST(variance AS DOUBLE), 4) AS variance, round(CAST(z AS DOUBLE), 6) AS z, round(sen, 4) AS sen, round(ols, 4) AS ols,
CASE WHEN abs(z) > 1.959964 THEN CASE WHEN z > 0 THEN 'rising' ELSE 'falling' END ELSE 'none' END AS direction FROM z"""


@query(MONTHLY_TREND)
def monthly_order_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann and Kendall's test, Theil and Sen's slope and the least squares slope of the monthly order value."""
    x = stats.trend(standins.monthly(spark, sf_dir), "t", "value")
    return x.select("n", "s", F.round("variance", 4).alias("variance"), F.round("z", 6).alias("z"), F.round("sen", 4).alias("sen"), F.round("ols", 4).alias("ols"), "direction")


@query(f"""
WITH {standins.DAILY}, x AS (SELECT kind, CAST(d - DATE '1970-01-01' AS DOUBLE) AS t, value AS y, row_number() OVER (PARTITION BY kind ORDER BY d, value) AS i FROM daily),
p AS (SELECT a.kind, sum(sign(b.y - a.y)) AS s, quantile_cont(CASE WHEN b.t <> a.t THEN (b.y - a.y) / (b.t - a.t) END, 0.5) AS sen FROM x a JOIN x b ON a.kind = b.kind AND a.i < b.i GROUP BY a.kind),
n AS (SELECT kind, count(*) AS n FROM x GROUP BY kind)
SELECT n.kind, n, CAST(s AS BIGINT) AS s, round(sen, 6) AS sen FROM n JOIN p ON n.kind = p.kind WHERE n >= 4""")
def trend_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = standins.daily(spark, sf_dir).withColumn("t", F.unix_date("d"))
    return stats.trend(x, "t", "value", "kind").select("kind", "n", "s", F.round("sen", 6).alias("sen"))


@query(f"""
WITH {standins.MONTHLY}, x AS (SELECT CAST(t AS DOUBLE) AS t, value AS y, row_number() OVER (ORDER BY t, value) AS i FROM monthly), {PAIRS},
s AS (SELECT quantile_cont((by_ - ay) / (bt - at_), 0.5) AS sen FROM pairs WHERE bt <> at_)
SELECT round(sen, 4) AS sen, round((SELECT quantile_cont(y - sen * t, 0.5) FROM x), 2) AS intercept FROM s""")
def theil_sen_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and intercept (median of the residuals) of the robust line."""
    x = standins.monthly(spark, sf_dir)
    slope = stats.trend(x, "t", "value").select("sen")
    joined = x.crossJoin(F.broadcast(slope))
    return joined.groupBy("sen").agg(F.median(F.col("value") - F.col("sen") * F.col("t")).alias("intercept")).select(F.round("sen", 4).alias("sen"), F.round("intercept", 2).alias("intercept"))


@query("""
WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY ALL)
SELECT e.event_type, round(median, 6) AS median, round(1.4826 * quantile_cont(abs(value - median), 0.5), 6) AS scale
FROM events e JOIN m ON e.event_type = m.event_type GROUP BY e.event_type, median""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robust_scale(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", *r6("median", "scale"))


@query("""
WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, count(*) OVER () AS rows FROM orders)
SELECT o_orderkey, CAST(position AS INT) AS position FROM x
WHERE rows <= 1500 OR round_even(round_even(position * 1499 / (rows - 1), 0) * (rows - 1) / 1499, 0) = position""")
def display_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spread rows of the orders by date, both ends included; a report of 1500 rows at most."""
    x = stats.display_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return x.select("o_orderkey", F.col("position").cast("int").alias("position"))


@query("""
WITH w AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT class, n, 500.0 * n / sum(n) OVER () AS share FROM w),
r AS (SELECT *, floor(share) AS whole, share - floor(share) AS rest FROM s),
k AS (SELECT *, 500 - sum(whole) OVER () AS left_, row_number() OVER (ORDER BY rest DESC, class) AS rank FROM r)
SELECT class, n, CAST(greatest(whole + CASE WHEN rank <= left_ THEN 1 ELSE 0 END, 50) AS BIGINT) AS allotted FROM k""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 sample places shared among order states, at least 50 for each."""
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("n"))
    return stats.largest_remainder(w, "n", 500, ["class"], least=50).select("class", "n", "allotted")


@query("""
WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS d FROM events), g AS (SELECT event_type, d - lag(d) OVER (PARTITION BY event_type ORDER BY d) AS gap FROM d)
SELECT event_type, round(quantile_cont(gap, 0.5), 6) AS median_gap, CAST(min(gap) AS INT) AS least_gap FROM g GROUP BY ALL""")
def date_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and least days between consecutive different dates."""
    from fieldloom.functions.dates import spacing

    return spacing(table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("d")), "d", "event_type").select("event_type", F.round("median_gap", 6).alias("median_gap"), "least_gap")


def _file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as a file of text: month-first dates, numbers with gaps, a name."""
    m = standins.monthly(spark, sf_dir)
    last = F.last_day(F.make_date("y", "m", F.lit(1)))
    value = F.when(F.col("m") % 5 != 0, F.round(F.col("value") / 1e6, 3).cast("string")).otherwise(F.lit("n/a"))
    return m.select(F.date_format(last, "MM/dd/yyyy").alias("Month"), value.alias("rain_mm"), F.round(F.col("value") / 1e9, 6).cast("string").alias("NDVI mean"), F.lit("plot").alias("site"))


FILE = f"""WITH {standins.MONTHLY}, f AS (SELECT last_day(make_date(y, m, 1)) AS d, CASE WHEN m % 5 <> 0 THEN round(value / 1e6, 3) END AS a, round(value / 1e9, 6) AS b FROM monthly),
long AS (SELECT 'rain_mm' AS "column", 'precip' AS metric, d, a AS v FROM f WHERE a IS NOT NULL UNION ALL SELECT 'NDVI mean', 'ndvi', d, b FROM f)"""


@query(FILE + """, x AS (SELECT *, year(d) + (dayofyear(d) - 1) / dayofyear(make_date(year(d), 12, 31)) AS t, lag(d) OVER (PARTITION BY "column" ORDER BY d) AS before FROM long),
p AS (SELECT a."column", sum(sign(b.v - a.v)) AS s, median((b.v - a.v) / (b.t - a.t)) AS slope FROM x a JOIN x b ON a."column" = b."column" AND a.d < b.d GROUP BY ALL),
k AS (SELECT "column", sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT "column", v, count(*) AS c FROM x GROUP BY ALL) GROUP BY ALL),
g AS (SELECT "column", any_value(metric) AS metric, count(*) AS n, avg(v) AS mean, min(d) AS first, max(d) AS last, median(date_diff('day', before, d)) AS gap, median(v) AS median FROM x GROUP BY ALL),
z AS (SELECT g.*, s, slope, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0) AS z FROM g JOIN p USING ("column") JOIN k USING ("column"))
SELECT "column", metric, (SELECT count(*) FROM f) - n AS missing, n, round(mean, 6) AS mean, round(median, 6) AS median, first, last, gap AS median_gap, CAST(s AS BIGINT) AS s, round(z, 6) AS z, round(slope, 9) AS slope, CASE WHEN abs(z) > 1.959964 THEN CASE WHEN z > 0 THEN 'rising' ELSE 'falling' END ELSE 'none' END AS direction, date_diff('day', first, last) / 365.25 < 1.9 AS short FROM z""")
def table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table job over months as a file of text: kinds, time axis with the month first, statistics and trend of each number."""
    x = jobs.report(jobs.described(_file(spark, sf_dir)))
    return x.select("column", "metric", "missing", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "first", "last", "median_gap", "s", F.round("z", 6).alias("z"), F.round("slope", 9).alias("slope"), "direction", "short")


@query(FILE + f""" SELECT "column", CASE WHEN metric = 'ndvi' THEN {classes.ladder_sql('CASE WHEN med > 1.5 AND med <= 10000 THEN v / 10000 ELSE v END', classes.NDVI)} ELSE {classes.ladder_sql('v', classes.RAIN)} END AS class, count(*) AS n FROM (SELECT *, median(v) OVER (PARTITION BY "column") AS med FROM long) GROUP BY ALL""")
def table_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of the file's known metrics each class has."""
    return jobs.class_counts(jobs.described(_file(spark, sf_dir)))
