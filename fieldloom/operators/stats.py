"""Descriptive statistics and trend tests, exact and null-skipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.session import cut


def finite(c: str) -> Column:
    """The value as a double; NaN and infinities are missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def with_keyed(x: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    """Rows of x with the row of small that has the same keys, nulls equal; without keys, with its only row."""
    if not keys:
        return x.crossJoin(F.broadcast(small))
    renamed = small.withColumnsRenamed({k: f"keyed_{k}" for k in keys})
    return x.join(renamed, [x[k].eqNullSafe(renamed[f"keyed_{k}"]) for k in keys], "left").drop(*[f"keyed_{k}" for k in keys])


def quantiles(df: DataFrame, value: str, shares: list[float], *keys: str, accuracy: int = 10_000) -> DataFrame:
    """keys and q, the exact type-7 quantiles at the given shares, without a map of all distinct values in one task.

    A first pass sketches bounds that are sure to hold each quantile's two ranks; the second counts equal values inside the bounds and only sums up those
    outside, so the last, sorted step sees some 4 n / accuracy values of each key and share."""
    v = df.select(*keys, finite(value).alias("v")).where("v is not null")
    slack = 2 / accuracy
    ends = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-slack, slack)]
    bounds = v.groupBy(*keys).agg(F.count("*").alias("rows"), F.percentile_approx("v", ends, accuracy).alias("b"))
    goals = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("share"), F.col("b")[2 * i].alias("low"), F.col("b")[2 * i + 1].alias("high")) for i, p in enumerate(shares)])
    joined = with_keyed(v, bounds, *keys)
    x = joined.select(*keys, "rows", "v", F.explode(goals).alias("g")).select(*keys, "rows", "v", "g.*")
    zone = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    x = x.withColumn("zone", zone).groupBy(*keys, "i", "share", "rows", "zone", F.when(F.col("zone") == 0, F.col("v")).alias("inside"))
    x = x.agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most")).withColumn("at", F.when(F.col("zone") < 0, F.col("most")).otherwise(F.col("least")))
    x = x.withColumn("upto", F.sum("c").over(W.partitionBy(*keys, "i").orderBy("zone", "at")))
    place = F.col("share") * (F.col("rows") - 1)
    # Below the bounds only the last rank is known, above them only the first: both may still be one of the two ranks.
    known = lambda r: F.when(F.col("zone") < 0, F.col("upto") == r + 1).when(F.col("zone") > 0, F.col("upto") - F.col("c") == r).otherwise((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r))
    lower, upper = F.floor(place), F.least(F.floor(place) + 1, F.col("rows") - 1)
    two = x.groupBy(*keys, "i", "share", "rows").agg(F.min(F.when(known(lower), F.col("at"))).alias("a"), F.min(F.when(known(upper), F.col("at"))).alias("z"))
    one = two.select(*keys, "i", (F.col("a") + (F.col("z") - F.col("a")) * (place - F.floor(place))).alias("quantile"))
    listed = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "quantile"))).alias("all"))
    q = listed.select(*keys, F.transform("all", lambda s: s["quantile"]).alias("q"))
    return q if keys else q.agg(F.any_value("q").alias("q"))


def summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, sample standard deviation (0 for one value), extremes and exact type-7 quartiles."""
    v = finite(value)
    moments = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    x = with_keyed(moments, quantiles(df, value, [0.25, 0.5, 0.75], *keys), *keys)
    return x.select(*keys, "n", "mean", "sd", "min", "max", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from the least to the largest value; the upper end belongs to the last bin, constant data to the only one."""
    v = df.select(finite(value).alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))  # one row
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)))).otherwise(0)
    counts = v.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("low", "high", F.explode(F.sequence(F.lit(0), F.when(F.col("high") > F.col("low"), bins - 1).otherwise(0).cast("int"))).alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    return every.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def pair_slopes(df: DataFrame, time: str, value: str, *keys: str) -> DataFrame:
    """All ordered pairs of one series' points: sign of the change and, where times differ, its slope. Quadratic in a series' length, so for series, not for tables."""
    x = df.select(*keys, F.col(time).cast("double").alias("t"), finite(value).alias("y")).where("t is not null and y is not null")
    order = W.partitionBy(*keys).orderBy("t", "y")
    x = x.withColumn("i", F.row_number().over(order))
    a, b = x.alias("a"), x.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.i") < F.col("b.i")]
    joined = a.join(b, on)
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.signum(F.col("b.y") - F.col("a.y")).alias("sign"), F.when(F.col("b.t") != F.col("a.t"), (F.col("b.y") - F.col("a.y")) / (F.col("b.t") - F.col("a.t"))).alias("slope"))


def variance_of_s(n: Column, ties: Column) -> Column:
    """Variance of Mann and Kendall's S, corrected for ties (sum of t (t - 1) (2 t + 5))."""
    return (n * (n - 1) * (2 * n + 5) - ties) / 18.0


def z_score(s: Column, variance: Column) -> Column:
    return F.when((s == 0) | (variance <= 0), 0.0).otherwise((s - F.signum(s)) / F.sqrt(variance))


def direction(z: Column) -> Column:
    return F.when(F.abs(z) > 1.959964, F.when(z > 0, "rising").otherwise("falling")).otherwise("none")


def trend(df: DataFrame, time: str, value: str, *keys: str) -> DataFrame:
    """n, S, its variance, z, Theil and Sen's slope, ordinary least squares' slope, and direction; series of fewer than 4 points have none."""
    x = df.select(*keys, F.col(time).cast("double").alias("t"), finite(value).alias("y")).where("t is not null and y is not null")
    base = x.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("y", "t"), F.lit(0.0)).alias("ols"))
    ties = x.groupBy(*keys, "y").agg(F.count("*").alias("m")).groupBy(*keys).agg(F.sum(F.col("m") * (F.col("m") - 1) * (2 * F.col("m") + 5)).alias("ties"))
    pairs = pair_slopes(df, time, value, *keys).groupBy(*keys).agg(F.sum("sign").cast("long").alias("s"), F.percentile("slope", F.lit(0.5)).alias("sen"))
    joined = base.join(ties, list(keys)).join(pairs, list(keys)) if keys else base.crossJoin(ties).crossJoin(pairs)
    return joined.where("n >= 4").withColumn("variance", variance_of_s(F.col("n"), F.col("ties"))).withColumn("z", z_score(F.col("s"), F.col("variance"))).select(*keys, "n", "s", "variance", "z", "sen", "ols", direction(F.col("z")).alias("direction"))


def robust_scale(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation."""
    v = df.select(*keys, finite(value).alias("v")).where("v is not null")
    middle = quantiles(v, "v", [0.5], *keys).select(*keys, F.col("q")[0].alias("median"))
    joined = with_keyed(v, middle, *keys)
    apart = quantiles(joined.select(*keys, F.abs(F.col("v") - F.col("median")).alias("apart")), "apart", [0.5], *keys)
    return with_keyed(middle, apart, *keys).select(*keys, "median", (1.4826 * F.col("q")[0]).alias("scale"))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds position (from 0) in the given order and the number of rows. Rows are numbered inside ranges of the order, which a checkpoint holds still; only
    the ranges' counts are added up in one place."""
    x = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = x.groupBy("part").agg(F.count("*").alias("c"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(W.partitionBy()).alias("rows"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return x.join(F.broadcast(starts), "part").withColumn("position", (F.col("start") + inside).cast("long")).drop("part", "start")


def display_sample(df: DataFrame, order: list[str], most: int = 1500) -> DataFrame:
    """At most `most` rows at evenly spread positions, the first and the last among them."""
    x = positions(df, order)
    k = F.col("position") * (most - 1) / (F.col("rows") - 1)
    near = F.rint(F.rint(k) * (F.col("rows") - 1) / (most - 1))
    return x.where((F.col("rows") <= most) | (near == F.col("position"))).drop("rows")


def largest_remainder(df: DataFrame, weight: str, total: int, order: list[str], least: int = 0) -> DataFrame:
    """Whole numbers proportional to weights that sum to total: shares are cut off, and the largest remainders get one more; then each gets `least` at least, which can raise the sum. Where all weights are 0, shares are 0 and the first `total` rows get one. For tables of classes, which one task takes."""
    share = F.coalesce(F.try_divide(total * F.col(weight), F.sum(weight).over(W.partitionBy())), F.lit(0.0))
    x = df.withColumns({"whole": F.floor(share), "rest": share - F.floor(share)})
    left = F.lit(total) - F.sum("whole").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc("rest"), *order))
    return x.withColumn("allotted", F.greatest(F.col("whole") + (rank <= left).cast("int"), F.lit(least)).cast("long")).drop("whole", "rest")
