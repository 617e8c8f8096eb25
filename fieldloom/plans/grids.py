"""Queries over cell tables: masks, indices, changes, areas, composites and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import cells
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins

BANDS = "SELECT l_orderkey, l_linenumber, l_tax + 0.01 AS red, l_discount + 0.05 AS nir, l_quantity / 100 AS green, l_quantity / 120 AS swir FROM lineitem"


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reflectances for each line."""
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_returnflag", (F.col("l_tax") + 0.01).alias("red"), (F.col("l_discount") + 0.05).alias("nir"), (F.col("l_quantity") / 100).alias("green"), (F.col("l_quantity") / 120).alias("swir"))


@query(f"""
SELECT round(avg((nir - red) / (nir + red)), 6) AS ndvi, round(avg((green - nir) / (green + nir)), 6) AS ndwi,
round(avg((nir - swir) / (nir + swir)), 6) AS nbr, round(avg(1.5 * (nir - red) / (nir + red + 0.5)), 6) AS savi,
round(avg(2.5 * (nir - red) / (nir + 6 * red - 7.5 * green / 10 + 1)), 6) AS evi, count(*) AS n FROM ({BANDS})""")
def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bands(spark, sf_dir)
    c = {k: F.col(k) for k in ("red", "nir", "green", "swir")}
    x = b.select(
        cells.index("NDVI", nir=c["nir"], red=c["red"]).alias("ndvi"), cells.index("NDWI", green=c["green"], nir=c["nir"]).alias("ndwi"), cells.index("NBR", nir=c["nir"], swir2=c["swir"]).alias("nbr"),
        cells.index("SAVI", nir=c["nir"], red=c["red"]).alias("savi"), cells.index("EVI", nir=c["nir"], red=c["red"], blue=c["green"] / 10).alias("evi"),
    )
    return x.agg(*[F.round(F.avg(k), 6).alias(k) for k in ("ndvi", "ndwi", "nbr", "savi", "evi")], F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) AS n, round(avg(CASE WHEN CAST(user_id AS INT) & 63 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS masked,
round(avg(CASE WHEN user_id % 12 IN (0, 1, 3, 8, 9, 10, 11) THEN 1.0 ELSE 0.0 END), 6) AS clouded,
round(avg(CASE WHEN CAST(user_id AS INT) & 63 = 0 THEN value END), 6) AS clear_mean FROM events GROUP BY event_type""")
def qa_bitmask_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cells that a quality word or a scene class masks, and the mean of those left."""
    e = table(spark, sf_dir, "events").select("event_type", "value", cells.masked_by_bits(F.col("user_id")).alias("masked"), cells.masked_by_scene(F.col("user_id") % 12).alias("clouded"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), share("masked"), share("clouded"), F.round(F.avg(F.when(~F.col("masked"), F.col("value"))), 6).alias("clear_mean"))


LOSS_SQL = "CASE WHEN before >= 0.05 AND after - before <= -0.1 THEN 2 WHEN before < 0.05 AND after - before >= 0.1 THEN 3 WHEN before >= 0.05 THEN 1 ELSE 4 END"


@query(f"WITH {standins.TWO_DATES}, c AS (SELECT {LOSS_SQL} AS class, 0.01 + row * 0.0001 AS area FROM two) SELECT CAST(class AS INT) AS class, count(*) AS cells, round(CAST(sum(area) AS DOUBLE), 6) AS area FROM c GROUP BY class")
def two_date_change_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and area of forest, loss and gain between two dates; the cell area depends on the row, as on an ellipsoid."""
    x = standins.two_dates(spark, sf_dir)
    x = x.withColumn("class", cells.loss_classes(F.col("before"), F.col("after"), 0.05, -0.1))
    return cells.class_totals(x, "class", 0.01 + F.col("row") * 0.0001).select("class", "cells", F.round("area", 6).alias("area"))


@query(f"""
WITH {standins.TWO_DATES}, c AS (SELECT CASE WHEN before >= 0.02 AND after >= 0.02 THEN 2 WHEN after >= 0.02 THEN 3 WHEN before >= 0.02 THEN 4 ELSE 1 END AS class,
CASE WHEN before <= -0.9 OR after <= -0.9 THEN 0 WHEN 10 * log10((after + 1) / (before + 1)) <= -1 THEN 1 WHEN 10 * log10((after + 1) / (before + 1)) >= 1 THEN 3 ELSE 2 END AS radar FROM two)
SELECT CAST(class AS INT) AS class, CAST(radar AS INT) AS radar, count(*) AS n FROM c GROUP BY ALL""")
def water_and_radar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = standins.two_dates(spark, sf_dir)
    water = cells.water_classes(F.col("before"), F.col("after"), 0.02)
    radar = F.when((F.col("before") <= -0.9) | (F.col("after") <= -0.9), 0).otherwise(cells.radar_change(F.col("before") + 1, F.col("after") + 1, 1.0))
    return x.groupBy(water.alias("class"), radar.alias("radar")).agg(F.count("*").alias("n"))


@query("SELECT CAST(2000 + o_orderkey % 20 AS BIGINT) AS year, count(*) AS cells, round(sum(o_totalprice), 2) AS area FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 20 >= 1 GROUP BY ALL")
def loss_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and area of loss for each year code of a baseline forest."""
    o = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 20 >= 1))
    return o.groupBy((2000 + F.col("o_orderkey") % 20).cast("long").alias("year")).agg(F.count("*").alias("cells"), F.round(F.sum("o_totalprice"), 2).alias("area"))


@query("""
SELECT CAST(user_id % 40 AS BIGINT) AS row, CAST(user_id // 40 AS BIGINT) AS col, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS clear
FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def median_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the clear observations of each cell, and how many there were."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    row, col = (F.col("user_id") % 40).cast("long"), F.floor(F.col("user_id") / 40).cast("long")
    return e.groupBy(row.alias("row"), col.alias("col")).agg(F.round(F.median("value"), 6).alias("median"), F.count("*").alias("clear"))


@query(f"""
WITH {standins.GRID}, s AS (SELECT max(row) + 1 AS rows FROM grid), b AS (SELECT row // 7 AS block_row, col // 7 AS block_col, avg(z) AS m, count(z) AS n FROM grid GROUP BY ALL)
SELECT CAST(block_row AS INT) AS block_row, CAST(block_col AS INT) AS block_col, n, round(CASE WHEN n >= least(7, rows - block_row * 7) * 7 / 2 THEN m END, 6) AS mean FROM b, s""")
def block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = standins.grid(spark, sf_dir)
    rows = g.agg(F.max("row")).first()[0] + 1
    return cells.block_means(g, "z", 7, rows).select("block_row", "block_col", "n", F.round("mean", 6).alias("mean"))


NINE = f"""WITH {standins.GRID}, across AS (SELECT *, lag(z) OVER w AS l, lead(z) OVER w AS r FROM grid WINDOW w AS (PARTITION BY row ORDER BY col)),
nine AS (SELECT row, col, lag(l) OVER w AS a, lag(z) OVER w AS b, lag(r) OVER w AS c, l AS d, z AS e, r AS f, lead(l) OVER w AS g, lead(z) OVER w AS h, lead(r) OVER w AS i FROM across WINDOW w AS (PARTITION BY col ORDER BY row)),
grad AS (SELECT row, col, ((c + 2 * f + i) - (a + 2 * d + g)) / 8 AS gx, ((g + 2 * h + i) - (a + 2 * b + c)) / 8 AS gy FROM nine WHERE a + b + c + d + e + f + g + h + i IS NOT NULL),
horn AS (SELECT row, col, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, (450 - degrees(atan2(gy, -gx))) AS turn, gx, gy FROM grad)"""


@query(NINE + """ SELECT row, col, round(slope, 5) AS slope, round(CASE WHEN slope >= 2 THEN turn - 360 * floor(turn / 360) END, 4) AS aspect,
round(greatest(0, cos(radians(45)) * cos(radians(slope)) + sin(radians(45)) * sin(radians(slope)) * cos(radians(135) - CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE atan2(gy, -gx) END)), 6) AS shade FROM horn""")
def slope_horn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope, aspect and hillshade of the inner cells."""
    x = cells.horn(cells.neighbourhood(standins.grid(spark, sf_dir), "z")).where("slope is not null")
    return x.select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 4).alias("aspect"), F.round("shade", 6).alias("shade"))


@query(NINE + """, k AS (SELECT CAST(CASE WHEN slope < 2 THEN 0 WHEN slope < 5 THEN 1 WHEN slope < 15 THEN 2 WHEN slope < 30 THEN 3 WHEN slope < 45 THEN 4 ELSE 5 END AS INT) AS slope_class,
CAST(CASE WHEN slope >= 2 THEN CAST(round_even((turn - 360 * floor(turn / 360)) / 45, 0) AS INT) % 8 ELSE -1 END AS INT) AS sector FROM horn) SELECT slope_class, sector, count(*) AS n FROM k GROUP BY ALL""")
def terrain_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by slope class and compass sector (-1: flat)."""
    from fieldloom.functions.classes import SLOPE, ladder

    x = cells.horn(cells.neighbourhood(standins.grid(spark, sf_dir), "z")).where("slope is not null")
    sector = F.coalesce(F.rint(F.col("aspect") / 45).cast("int") % 8, F.lit(-1))
    return x.groupBy(ladder(F.col("slope"), SLOPE).alias("slope_class"), sector.alias("sector")).agg(F.count("*").alias("n"))


MIRRORED = """e AS (SELECT max(row) AS lr, max(col) AS lc FROM p),
v AS (SELECT row, col, z, false AS ghost FROM p UNION ALL SELECT -1 - row, col, z, true FROM p WHERE row < {k} UNION ALL SELECT 2 * lr + 1 - row, col, z, true FROM p, e WHERE row > lr - {k}),
g AS (SELECT row, col, z, ghost FROM v UNION ALL SELECT row, -1 - col, z, true FROM v WHERE col < {k} UNION ALL SELECT row, 2 * lc + 1 - col, z, true FROM v, e WHERE col > lc - {k})"""
LOCAL = f"""WITH {standins.GRID}, p AS (SELECT row, col, z + 1 AS z FROM grid), {MIRRORED.format(k=2)},
a AS (SELECT *, sum(z) OVER w AS s1, sum(z * z) OVER w AS s2, count(z) OVER w AS s0 FROM g WINDOW w AS (PARTITION BY row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT row, col, z, ghost, sum(s1) OVER w / sum(s0) OVER w AS mean, greatest(0, sum(s2) OVER w / sum(s0) OVER w - (sum(s1) OVER w / sum(s0) OVER w) ** 2) AS variance FROM a WINDOW w AS (PARTITION BY col ORDER BY row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT * FROM b WHERE NOT ghost)"""


@query(LOCAL + " SELECT row, col, round(mean, 6) AS mean, round(variance, 6) AS variance, round(mean + CASE WHEN variance > 0 THEN greatest((variance - mean * mean / 100) / (1 + 1 / 100.0), 0) / variance ELSE 0 END * (z - mean), 6) AS filtered FROM m")
def local_mean_var_lee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local mean and variance over 5 x 5 cells, mirrored at the edge, and the speckle filter."""
    g = standins.grid(spark, sf_dir).withColumn("z", F.col("z") + 1)
    x = cells.lee(cells.local_mean_variance(g, "z", 5), "z", looks=100.0)
    return x.select("row", "col", *[F.round(k, 6).alias(k) for k in ("mean", "variance", "filtered")])


KERNEL = "(VALUES (0, exp(0.0)), (1, exp(-0.5 / 0.4489)), (2, exp(-2 / 0.4489)), (3, exp(-4.5 / 0.4489))) t(d, w)"


@query(f"""
WITH {standins.GRID}, p AS (SELECT row, col, z FROM grid), {MIRRORED.format(k=3)}, k AS (SELECT d, w / (SELECT sum(CASE WHEN d = 0 THEN w ELSE 2 * w END) FROM {KERNEL}) AS w FROM {KERNEL}),
a AS (SELECT x.row, x.col, any_value(x.ghost) AS ghost, sum(k.w * y.z) AS z FROM g x JOIN g y ON y.row = x.row AND y.col BETWEEN x.col - 3 AND x.col + 3 JOIN k ON k.d = abs(y.col - x.col) GROUP BY ALL)
SELECT x.row, x.col, round(sum(k.w * y.z), 6) AS smooth FROM a x JOIN a y ON y.col = x.col AND y.row BETWEEN x.row - 3 AND x.row + 3 JOIN k ON k.d = abs(y.row - x.row) WHERE NOT x.ghost GROUP BY x.row, x.col""")
def gaussian_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells smoothed by a Gaussian of 0.67 cells, mirrored at the edge."""
    return cells.gaussian(standins.grid(spark, sf_dir), "z", 0.67).select("row", "col", F.round("smooth", 6).alias("smooth"))


@query(f"""
WITH {standins.GRID}, t AS (SELECT * FROM grid WHERE z > 0.2)
SELECT row, col, round(z, 6) AS z FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE (u.row - t.row) ** 2 + (u.col - t.col) ** 2 <= 9 AND abs(u.row - t.row) <= 3 AND (u.z > t.z OR (u.z = t.z AND (u.row < t.row OR (u.row = t.row AND u.col < t.col)))))""")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree tops: cells that are the highest within three cells."""
    return cells.local_maxima(standins.grid(spark, sf_dir), "z", 3, 0.2).select("row", "col", F.round("z", 6).alias("z"))


@query(f"""
WITH {standins.GRID}, e AS (SELECT min(z) AS low, max(z) AS high FROM grid),
h AS (SELECT CAST(least(255, floor((z - low) / ((high - low) / 256))) AS INT) AS bin, count(*) AS n FROM grid, e GROUP BY ALL),
f AS (SELECT b.bin, coalesce(n, 0) AS n, low, high, low + (b.bin + 0.5) * (high - low) / 256 AS mid FROM (SELECT CAST(unnest(range(256)) AS INT) AS bin) b CROSS JOIN e LEFT JOIN h ON h.bin = b.bin),
c AS (SELECT *, sum(n) OVER o AS w0, sum(n * mid) OVER o AS m0, sum(n) OVER () AS w, sum(n * mid) OVER () AS m FROM f WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, round(w0 * (w - w0) * (m0 / w0 - (m - m0) / (w - w0)) ** 2, 6) AS between_ FROM c WHERE w0 > 0 AND w0 < w)
SELECT round(min(low) + ((min(bin) + max(bin)) / 2.0 + 1) * (min(high) - min(low)) / 256, 6) AS threshold FROM v WHERE between_ = (SELECT max(between_) FROM v)""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.otsu(standins.grid(spark, sf_dir), "z").select(F.round("threshold", 6).alias("threshold"))
