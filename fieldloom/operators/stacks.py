"""Dated stacks of images: a row for each image, the trend over images, disturbances by date, and small patches put into another class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import stats

# Fixed value: images with a smaller share of valid cells are listed, but left out of the trend.
LEAST_VALID = 0.2


def image_rows(cells: DataFrame, date: str, value: str) -> DataFrame:
    """date, mean, median, valid (share of cells with a value) and sparse for each image. Cells without a value are rows with a null."""
    v = stats.finite(value)
    shares = cells.groupBy(date).agg(F.avg(v).alias("mean"), (F.count(v) / F.count("*")).alias("valid"))
    x = stats.with_keyed(shares, stats.quantiles(cells, value, [0.5], date), date)
    return x.select(date, "mean", F.get("q", F.lit(0)).alias("median"), "valid", (F.col("valid") < LEAST_VALID).alias("sparse"))


def decimal_year(date: Column) -> Column:
    """Years with the share of the year that has passed."""
    days = F.datediff(F.make_date(F.year(date) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(date), F.lit(1), F.lit(1)))
    return F.year(date) + (F.dayofyear(date) - 1) / days


def stack_trend(rows: DataFrame, date: str) -> DataFrame:
    """Trend of the images' means by stats.trend(), sparse images left out."""
    x = rows.where(~F.col("sparse") & F.col("mean").isNotNull()).select(decimal_year(F.col(date)).alias("t"), "mean")
    return stats.trend(x, "t", "mean")


def first_and_latest(breaks: DataFrame, at: str, *cell: str) -> DataFrame:
    """Number, first and latest disturbance of each cell that has any; null dates are none."""
    return breaks.where(F.col(at).isNotNull()).groupBy(*cell).agg(F.count("*").alias("disturbances"), F.min(at).alias("first"), F.max(at).alias("latest"))


def disturbed_by_date(breaks: DataFrame, at: str, area: str, *cell: str) -> DataFrame:
    """For each date the cells and area disturbed at all, and those disturbed for the first time. Two rows of a cell and date count as one; area belongs to the cell."""
    x = breaks.where(F.col(at).isNotNull()).groupBy(*cell, at).agg(F.max(area).alias("a"))
    first = x.groupBy(*cell).agg(F.min(at).alias("date"), F.max("a").alias("a"))
    new = first.groupBy("date").agg(F.count("*").alias("first_cells"), F.sum("a").alias("first_area"))
    every = x.groupBy(F.col(at).alias("date")).agg(F.count("*").alias("cells"), F.sum("a").alias("area"))
    return every.join(new, "date", "left").select("date", "cells", "area", F.coalesce("first_cells", F.lit(0)).alias("first_cells"), F.coalesce("first_area", F.lit(0.0)).alias("first_area"))


def without_small_patches(cells: DataFrame, patches: DataFrame, area: Column, least: float, cls: str, other: int) -> DataFrame:
    """cells with the class `other` where they belong to a patch of less than the minimum unit. patches: row, col, patch of the target cells.

    Areas are added up by patch and joined back by patch: a window over a patch would hold the largest one in one task."""
    whole = cells.join(patches, ["row", "col"], "left").withColumn("patch_cell", area)
    small = whole.where("patch is not null").groupBy("patch").agg(F.sum("patch_cell").alias("patch_area")).where(F.col("patch_area") < least).select("patch", F.lit(True).alias("small"))
    return whole.join(small, "patch", "left").withColumn(cls, F.when(F.col("small"), F.lit(other)).otherwise(F.col(cls))).drop("patch_cell", "small", "patch")


def removal_report(patches: DataFrame, area: Column, least: float) -> DataFrame:
    """One row: patches, cells and area that go, the number of patches that stay and the largest of them."""
    p = patches.withColumn("a", area).groupBy("patch").agg(F.count("*").alias("n"), F.sum("a").alias("a"))
    small = F.col("a") < least
    return p.agg(
        F.count_if(small).alias("removed_patches"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("removed_cells"), F.coalesce(F.sum(F.when(small, F.col("a"))), F.lit(0.0)).alias("removed_area"),
        F.count_if(~small).alias("kept"), F.coalesce(F.max(F.when(~small, F.col("a"))), F.lit(0.0)).alias("largest"),
    )
