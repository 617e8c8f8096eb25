"""Ladders of value classes: the first bound that a value is below gives its class, and the last class is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the classes of known quantities.
NDVI = (0.0, 0.1, 0.2, 0.4, 0.6)
EVI = (0.1, 0.2, 0.4)
TEMPERATURE = (0.0, 10.0, 20.0, 30.0, 40.0)
RAIN = (0.1, 2.5, 15.6, 64.5, 115.6, 204.5)
EVAPOTRANSPIRATION = (1.0, 3.0, 5.0, 7.0)
SOLAR = (8.0, 16.0, 24.0)
SOIL_MOISTURE = (0.1, 0.2, 0.3, 0.4)
HUMIDITY = (30.0, 60.0, 80.0)
BURN_SEVERITY = (-0.25, -0.1, 0.1, 0.27, 0.44, 0.66)
SLOPE = (2.0, 5.0, 15.0, 30.0, 45.0)
CANOPY_HEIGHT = (2.0, 5.0, 10.0, 20.0, 30.0)
DIAMETER = (5.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 80.0, 100.0)


def ladder(v: Column, bounds: tuple[float, ...]) -> Column:
    """The class from 0; null for a missing value."""
    out = F.when(v.isNull(), None)
    for i, b in enumerate(bounds):
        out = out.when(v < b, i)
    return out.otherwise(len(bounds)).cast("int")


def ladder_sql(v: str, bounds: tuple[float, ...]) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {v} < {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END AS INT)"


def class_counts(df: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """How many values each class of the ladder has, empty classes included."""
    counts = df.where(F.col(value).isNotNull()).groupBy(ladder(F.col(value), bounds).alias("class")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("class"))
    return every.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def spi_class(v: Column) -> Column:
    """Classes of the standardised precipitation index from -3 (extremely dry) to 3; wet bounds belong to the wetter class, dry bounds to the drier one."""
    return F.when(v >= 2, 3).when(v >= 1.5, 2).when(v >= 1, 1).when(v <= -2, -3).when(v <= -1.5, -2).when(v <= -1, -1).otherwise(F.when(v.isNotNull(), 0))


def kp_label(v: Column) -> Column:
    """Storm label of a Kp index: G1 from 5 to G5 at 9, unsettled from 3, active from 4, else quiet."""
    return F.when(v >= 9, "G5").when(v >= 8, "G4").when(v >= 7, "G3").when(v >= 6, "G2").when(v >= 5, "G1").when(v >= 4, "active").when(v >= 3, "unsettled").otherwise(F.when(v.isNotNull(), "quiet"))
