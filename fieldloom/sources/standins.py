"""Stand-ins: the driver's relational tables read as series, grids, inventories and catalogues, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a month: y, m, t (month number) and value."""
    d = _read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    return d.groupBy(F.year("d").alias("y"), F.month("d").alias("m")).agg(F.sum("o_totalprice").alias("value")).withColumn("t", F.col("y") * 12 + F.col("m") - 1)


MONTHLY = "monthly AS (SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, sum(o_totalprice) AS value, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS t FROM orders GROUP BY ALL)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a day and kind of event: kind, d and value (mean)."""
    return _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("d")).agg(F.avg("value").alias("value"))


DAILY = "daily AS (SELECT event_type AS kind, CAST(ts AS DATE) AS d, avg(value) AS value FROM events GROUP BY ALL)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense grid of cells: row, col and z."""
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "z")).withColumn("z", F.col("z").cast("double"))


GRID = "grid AS (SELECT CAST(vec_id AS INT) AS row, CAST(unnest(range(len(embedding))) AS INT) AS col, CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings)"


def two_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dates of one grid: row, col, before and after."""
    g = grid(spark, sf_dir)
    a = g.where("row % 2 = 0").select((F.col("row") / 2).cast("int").alias("row"), "col", F.col("z").alias("before"))
    b = g.where("row % 2 = 1").select(((F.col("row") - 1) / 2).cast("int").alias("row"), "col", F.col("z").alias("after"))
    return a.join(b, ["row", "col"])


TWO_DATES = GRID + ", two AS (SELECT CAST(a.row // 2 AS INT) AS row, a.col, a.z AS before, b.z AS after FROM grid a JOIN grid b ON b.row = a.row + 1 AND b.col = a.col WHERE a.row % 2 = 0)"


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree inventory: plot, species, dbh, height, status and line."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("plot"), F.col("p_brand").alias("species"), (F.col("l_quantity") * 2).alias("dbh"), (F.col("l_extendedprice") / 5000 + 2).alias("height"), F.col("l_returnflag").alias("status")
    )


TREES = "trees AS (SELECT l_suppkey AS plot, p_brand AS species, l_quantity * 2 AS dbh, l_extendedprice / 5000 + 2 AS height, l_returnflag AS status FROM lineitem JOIN part ON l_partkey = p_partkey)"
