"""Monthly series, climatology, rainfall and drought."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.dist import spi_value
from fieldloom.operators.stats import pair_slopes, variance_of_s


def monthly_means(df: DataFrame, date: str, value: str, *keys: str) -> DataFrame:
    """y, m, mean, n and the share of the month's days with a value."""
    x = df.select(*keys, F.col(date).alias("d"), F.col(value).alias("v")).where("d is not null and v is not null")
    days = F.dayofmonth(F.last_day(F.make_date(F.col("y"), F.col("m"), F.lit(1))))
    return x.groupBy(*keys, F.year("d").alias("y"), F.month("d").alias("m")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"), F.count_distinct("d").alias("days")).select(*keys, "y", "m", "mean", "n", (F.col("days") / days).alias("coverage"))


def climatology(monthly: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation (null for one year) and years of each calendar month."""
    return monthly.groupBy("m").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("years"))


def anomalies(monthly: DataFrame, value: str) -> DataFrame:
    """Difference from the calendar month's mean, and that in its deviations."""
    w = W.partitionBy("m")
    a = F.col(value) - F.avg(value).over(w)
    return monthly.withColumns({"anomaly": a, "z": F.when(F.stddev_samp(value).over(w) > 0, a / F.stddev_samp(value).over(w))})


def rolling_total(monthly: DataFrame, value: str, k: int) -> DataFrame:
    """Sums over k calendar months, on a calendar without gaps; null where a month is missing."""
    ends = monthly.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b")).alias("t"))
    x = every.join(monthly.select("t", F.col(value).alias("v")), "t", "left")
    w = W.orderBy("t").rowsBetween(-(k - 1), 0)
    return x.select("t", F.when(F.count("v").over(w) == k, F.sum("v").over(w)).alias("total"))


def rain_indices(daily: DataFrame, date: str, value: str, *keys: str, rainy: float = 2.5) -> DataFrame:
    """Total, rainy days, wettest day (the first of equals), missing days, and the longest run of days below the limit; a gap ends a run."""
    x = daily.select(*keys, F.col(date).alias("d"), F.col(value).alias("v")).where("d is not null and v is not null")
    base = x.groupBy(*keys).agg(
        F.sum("v").alias("total"), F.count_if(F.col("v") >= rainy).alias("rainy_days"), F.max("v").alias("wettest"),
        F.max_by("d", F.struct("v", -F.unix_date("d"))).alias("wettest_day"), (F.datediff(F.max("d"), F.min("d")) + 1 - F.count_distinct("d")).cast("long").alias("missing_days"),
    )
    dry = x.where(F.col("v") < rainy)
    run = dry.withColumn("run", F.date_sub("d", F.row_number().over(W.partitionBy(*keys).orderBy("d"))))
    longest = run.groupBy(*keys, "run").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("dry_spell"))
    out = base.join(longest, list(keys), "left") if keys else base.crossJoin(longest)
    return out.withColumn("dry_spell", F.coalesce("dry_spell", F.lit(0)))


def seasonal_kendall(monthly: DataFrame, value: str) -> DataFrame:
    """S and its variance over calendar months with two values or more, z, and the median slope a year inside months."""
    pairs = pair_slopes(monthly, "y", value, "m")
    s = pairs.agg(F.sum("sign").cast("long").alias("s"), F.percentile("slope", F.lit(0.5)).alias("slope"))
    n = monthly.where(F.col(value).isNotNull()).groupBy("m").agg(F.count("*").alias("n"))
    ties = monthly.where(F.col(value).isNotNull()).groupBy("m", value).agg(F.count("*").alias("k")).groupBy("m").agg(F.sum(F.col("k") * (F.col("k") - 1) * (2 * F.col("k") + 5)).alias("ties"))
    v = n.where("n >= 2").join(ties, "m").agg(F.sum(variance_of_s(F.col("n"), F.col("ties"))).alias("variance"), F.sum("n").alias("n"))
    return s.crossJoin(v).where("variance > 0 and n >= 4").select("n", "s", "variance", ((F.col("s") - F.signum("s")) / F.sqrt("variance")).alias("z"), "slope")


def gamma_fit(totals: DataFrame, value: str) -> DataFrame:
    """By calendar month: share of zeros and Thom's gamma parameters of the positive totals; null with fewer than two of them."""
    v = F.col(value)
    x = totals.where(v.isNotNull()).groupBy("m").agg(F.avg((v <= 0).cast("double")).alias("q"), F.count_if(v > 0).alias("positive"), F.avg(F.when(v > 0, v)).alias("mean"), F.avg(F.ln(F.when(v > 0, v))).alias("log_mean"))
    a = F.ln("mean") - F.col("log_mean")
    alpha = F.when((F.col("positive") >= 2) & (a > 0), (1 + F.sqrt(1 + 4 * a / 3)) / (4 * a))
    return x.withColumn("alpha", alpha).withColumn("beta", F.col("mean") / F.col("alpha"))


def spi(monthly: DataFrame, value: str, k: int) -> DataFrame:
    """t, total and the standardised precipitation index over k months."""
    totals = rolling_total(monthly, value, k).withColumn("m", F.pmod("t", F.lit(12)) + 1)
    fit = gamma_fit(totals, "total")
    return totals.join(fit, "m").select("t", "m", "total", spi_value("total", "q", "alpha", "beta").alias("spi"))
