"""Queries that fit models; they have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import landcover
from fieldloom.plans.registry import query, table


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"b{i}") for i in range(6)])


@query()
def land_cover_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five classes by k-means, ranked by one band, with their cells and band means."""
    x = landcover.clusters(_cells(spark, sf_dir), [f"b{i}" for i in range(6)], 5, "b3", ["vec_id"])
    return x.groupBy("class").agg(F.count("*").alias("cells"), F.avg("b3").alias("mean"))


@query()
def land_cover_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random forest trained on every third cell, and its classes for all cells."""
    x = _cells(spark, sf_dir)
    return landcover.forest(x.where("vec_id % 3 = 0"), x, [f"b{i}" for i in range(6)], "label").select("vec_id", "label", "predicted")


@query()
def emission_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of emissions by Monte Carlo for each market segment."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("zone")).agg(F.count("*").cast("double").alias("area"), F.lit(120.0).alias("agb"), F.lit(0.25).alias("ratio"))
    return landcover.emission_draws(c.withColumns({"area_sd": F.col("area") * 0.05, "agb_sd": F.lit(15.0), "ratio_sd": F.lit(0.03)}))
