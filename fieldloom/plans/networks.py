"""Queries over graphs on grids, which are the whole stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import cells, chains, networks
from fieldloom.plans.grids import NINE
from fieldloom.plans.registry import query
from fieldloom.sources import standins

WIDTH = 64
HIGH = f"""WITH RECURSIVE {standins.GRID}, x AS (SELECT row, col, CAST(row AS BIGINT) * 64 + col AS id FROM grid WHERE z > 0.08),
e AS (SELECT a.id, b.id AS to_ FROM x a JOIN x b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT id, id AS patch FROM x UNION SELECT e.to_, r.patch FROM reach r JOIN e ON e.id = r.id WHERE r.patch < e.to_),
label AS (SELECT id, min(patch) AS patch FROM reach GROUP BY id)"""


def _high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.patches(standins.grid(spark, sf_dir).where("z > 0.08"), WIDTH)


@query(HIGH + " SELECT x.row, x.col, patch FROM label JOIN x ON x.id = label.id")
def components_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of high cells, connected over edges and corners."""
    return _high(spark, sf_dir)


@query(HIGH + ", p AS (SELECT patch, count(*) AS cells, sum(1 + row * 0.001) AS area FROM label JOIN x ON x.id = label.id GROUP BY patch) SELECT patch, cells, round(CAST(area AS DOUBLE), 6) AS area, area >= 4 AS kept FROM p")
def minimum_mapping_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = networks.minimum_units(_high(spark, sf_dir), 1 + F.col("row") * 0.001, 4.0)
    return x.select("patch", "cells", F.round("area", 6).alias("area"), "kept")


@query(HIGH + ", p AS (SELECT patch, count(*) AS cells FROM label GROUP BY patch) SELECT CAST(rank AS INT) AS rank, patch, cells FROM (SELECT *, row_number() OVER (ORDER BY cells DESC, patch) AS rank FROM p) WHERE rank <= 20")
def largest_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest patches, a report."""
    x = _high(spark, sf_dir).groupBy("patch").agg(F.count("*").alias("cells"))
    return networks.ranked_largest(x, "cells", ["patch"], 20).select("rank", "patch", "cells")


DIRECTED = f"""WITH RECURSIVE {standins.GRID}, k AS (SELECT * FROM (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)) t(k, i, j)),
s AS (SELECT g.row, g.col, k, i, j, round((g.z - o.z) / CASE WHEN i = 0 OR j = 0 THEN 1.0 ELSE sqrt(2.0) END, 9) AS slope FROM grid g, k JOIN grid o ON o.row = g.row + i AND o.col = g.col + j WHERE g.z > o.z),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY slope DESC, k) AS place FROM s) WHERE place = 1),
edges AS MATERIALIZED (SELECT CAST(row AS BIGINT) * 64 + col AS id, CAST(row + i AS BIGINT) * 64 + col + j AS to_ FROM b)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.downstream(networks.flow_direction(standins.grid(spark, sf_dir), "z"), WIDTH)


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.grid(spark, sf_dir).select((F.col("row").cast("long") * WIDTH + F.col("col")).alias("id"))


@query(DIRECTED + " SELECT g.row, g.col, CAST(coalesce(b.k, -1) AS INT) AS direction FROM grid g LEFT JOIN b ON b.row = g.row AND b.col = g.col")
def flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.flow_direction(standins.grid(spark, sf_dir), "z").select("row", "col", "direction")


@query(DIRECTED + ", path AS (SELECT CAST(row AS BIGINT) * 64 + col AS start, CAST(row AS BIGINT) * 64 + col AS id FROM grid UNION ALL SELECT p.start, e.to_ FROM path p JOIN edges e ON e.id = p.id) SELECT id, CAST(count(*) AS DOUBLE) AS total FROM path GROUP BY id")
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that drain through each cell, itself included."""
    ids = standins.grid(spark, sf_dir).select((F.col("row").cast("long") * WIDTH + F.col("col")).alias("id"), F.lit(1.0).alias("one"))
    return networks.flow_accumulation(ids, _edges(spark, sf_dir), "one")


@query(DIRECTED + ", up AS (SELECT CAST(100 * 64 + 20 AS BIGINT) AS id UNION SELECT e.id FROM edges e JOIN up ON e.to_ = up.id) SELECT id FROM up")
def watershed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells from which the flow reaches one outlet."""
    return chains.watershed(_edges(spark, sf_dir), _ids(spark, sf_dir), 100 * WIDTH + 20)


@query(f"WITH {standins.GRID}, t AS (SELECT row, col FROM grid WHERE z > 0.3), k AS (SELECT unnest(range(-1, 2)) AS i) SELECT DISTINCT CAST(row + a.i AS INT) AS row, CAST(col + b.i AS INT) AS col FROM t, k a, k b")
def dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within one cell of the highest ones."""
    return networks.dilate(standins.grid(spark, sf_dir).where("z > 0.3"), 1)


FRESH = HIGH.replace("WHERE z > 0.08)", "WHERE z > 0.08 AND row % 11 <> 0)")


@query(FRESH + ", p AS (SELECT patch, count(*) AS cells, CAST(sum(1 + row * 0.001) AS DOUBLE) AS area, avg(row) AS row, avg(col) AS col FROM label JOIN x ON x.id = label.id GROUP BY patch) SELECT patch, cells, round(area, 6) AS area, round(row, 6) AS row, round(col, 6) AS col FROM p WHERE area >= 4")
def emitted_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of confirmed cells that were not reported before and reach the least area."""
    g = standins.grid(spark, sf_dir).select("row", "col", (F.col("z") > 0.08).alias("confirmed"), (F.col("row") % 11 == 0).alias("reported"))
    alerts, _ = networks.emit_alerts(g, WIDTH, 1 + F.col("row") * 0.001, 4.0)
    return alerts.select("patch", "cells", *[F.round(c, 6).alias(c) for c in ("area", "row", "col")])


@query(DIRECTED + """, path AS (SELECT CAST(row AS BIGINT) * 64 + col AS start, CAST(row AS BIGINT) * 64 + col AS id FROM grid UNION ALL SELECT p.start, e.to_ FROM path p JOIN edges e ON e.id = p.id), acc AS (SELECT id, count(*) AS total FROM path GROUP BY id), """ + NINE.split(standins.GRID + ", ", 1)[1] + """
SELECT row, col, round(ln(total / greatest(sqrt(gx * gx + gy * gy), 0.001)), 6) AS wetness FROM grad JOIN acc ON acc.id = CAST(row AS BIGINT) * 64 + col""")
def wetness_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wetness of the inner cells from eight-way flow and the slope of the surface."""
    g = standins.grid(spark, sf_dir)
    at = F.col("row").cast("long") * WIDTH + F.col("col")
    total = networks.flow_accumulation(g.select(at.alias("id"), F.lit(1.0).alias("one")), _edges(spark, sf_dir), "one").select("id", "total")
    slopes = cells.horn(cells.neighbourhood(g, "z")).where("slope is not null").select("row", "col", F.hypot("gx", "gy").alias("tangent"), at.alias("id"))
    return slopes.join(total, "id").select("row", "col", F.round(networks.wetness(F.col("total"), F.col("tangent")), 6).alias("wetness"))
