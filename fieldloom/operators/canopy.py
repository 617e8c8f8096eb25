"""Canopy heights: grids from point clouds, cover and height statistics, the tallest trees, wood density by species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import classes
from fieldloom.operators import stats
from fieldloom.operators.cells import neighbourhood

# Fixed value: the height from which a cell is forest by the international definition, in metres.
FOREST_HEIGHT = 5.0


def gridded_extremes(points: DataFrame, x0: float, y1: float, size: float, width: int, height: int, first: Column, ground: Column) -> DataFrame:
    """row, col, highest first return and lowest ground return of points x, y, z. Points on the far edges belong to the last cells; others outside are left out."""
    inside = (F.col("x") >= x0) & (F.col("x") <= x0 + width * size) & (F.col("y") <= y1) & (F.col("y") >= y1 - height * size)
    col, row = F.least(F.floor((F.col("x") - x0) / size), F.lit(width - 1)), F.least(F.floor((y1 - F.col("y")) / size), F.lit(height - 1))
    x = points.where(inside).groupBy(row.cast("int").alias("row"), col.cast("int").alias("col"))
    return x.agg(F.max(F.when(first, F.col("z"))).alias("highest"), F.min(F.when(ground, F.col("z"))).alias("lowest"))


def canopy_statistics(cells: DataFrame, height: str, area: Column, threshold: float = 2.0) -> DataFrame:
    """One row: valid area, share of it under canopy and under forest height, and mean, quartiles, 95th percentile and maximum of the canopy cells."""
    x = cells.select(stats.finite(height).alias("h"), area.alias("a")).where("h is not null")
    high = F.col("h") >= threshold
    share = lambda least: F.sum(F.when(F.col("h") >= least, F.col("a")).otherwise(0.0)) / F.sum("a")
    canopy = F.when(high, F.col("h"))
    s = x.agg(F.sum("a").alias("area"), share(threshold).alias("cover"), share(FOREST_HEIGHT).alias("forest_cover"), F.avg(canopy).alias("mean"), F.max(canopy).alias("max"))
    q = stats.quantiles(x.where(high), "h", [0.25, 0.5, 0.75, 0.95])
    names = ("q1", "median", "q3", "p95")
    return stats.with_keyed(s, q).select("area", "cover", "forest_cover", "mean", "max", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def area_by_height(cells: DataFrame, height: str, area: Column) -> DataFrame:
    """Area of each class of canopy height; cells without a height, and those below zero, belong to none."""
    x = cells.select(stats.finite(height).alias("h"), area.alias("a")).where("h >= 0")
    return x.groupBy(classes.ladder(F.col("h"), classes.CANOPY_HEIGHT).alias("class")).agg(F.sum("a").alias("area"))


def tallest(trees: DataFrame, height: str, order: list[str], most: int = 20_000) -> DataFrame:
    """The tallest trees for a map, at most so many; equal ones by order."""
    return trees.orderBy(F.desc(height), *order).limit(most)


def with_density(trees: DataFrame, species: str, densities: DataFrame, default: float) -> DataFrame:
    """Adds density by species, or the default where the species isn't known. densities: species, density, one row a species; Spark broadcasts it if it is small."""
    known = densities.select(F.col("species").alias("known_species"), F.col("density").cast("double").alias("known_density"))
    x = trees.join(known, F.col(species) == F.col("known_species"), "left")
    return x.withColumn("density", F.coalesce("known_density", F.lit(default))).drop("known_species", "known_density")


def crown_width(height: Column) -> Column:
    """Expected width of a crown (m) by the tree's height (m). 3.75105, -0.17919 and 0.01241."""
    return 3.75105 - 0.17919 * height + 0.01241 * height * height


def tree_tops(cells: DataFrame, height: str, least: float, cell: float) -> DataFrame:
    """row, col, height and radius of the cells of the least height or more that no cell within their own expected crown exceeds; of equals, the first in scan order stays.

    The crown's radius counts in whole cells, one at least. Cells that a direct neighbour beats are out before the others look
    around, each as far as its own radius.
    """
    x = cells.select("row", "col", F.col(height).cast("double").alias("v")).where("v is not null and not isnan(v)")
    around = neighbourhood(x, "v")
    before, after = [F.coalesce(F.col(k) >= F.col("e"), F.lit(False)) for k in "abcd"], [F.coalesce(F.col(k) > F.col("e"), F.lit(False)) for k in "fghi"]
    # A diagonal neighbour is farther than a radius of one.
    radius = F.greatest(F.lit(1), F.floor(crown_width(F.col("e")) / 2 / cell + 0.5).cast("int"))
    far = F.col("radius") > 1
    beaten = before[1] | before[3] | after[0] | after[2] | (far & (before[0] | before[2] | after[1] | after[3]))
    tops = around.where(F.col("e") >= least).withColumn("radius", radius).where(~beaten).select("row", "col", "e", "radius")
    steps = F.sequence(-F.col("radius"), F.col("radius"))
    wide = tops.where("radius > 1")
    looks = wide.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).where("i * i + j * j <= radius * radius and (i <> 0 or j <> 0)")
    looks = looks.select(F.col("row").alias("r"), F.col("col").alias("c"), "e", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col"), ((F.col("i") < 0) | ((F.col("i") == 0) & (F.col("j") < 0))).alias("earlier"))
    lost = looks.join(x, ["row", "col"]).where((F.col("v") > F.col("e")) | ((F.col("v") == F.col("e")) & F.col("earlier"))).select(F.col("r").alias("row"), F.col("c").alias("col")).distinct()
    return tops.join(lost, ["row", "col"], "left_anti").select("row", "col", F.col("e").alias(height), "radius")
