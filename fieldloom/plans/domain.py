"""Queries of the domain: biomass, emissions, accuracy, areas, polygons and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import classes
from fieldloom.operators import carbon, vector
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins

AGB = "0.0673 * pow(0.57 * dbh * dbh * height, 0.976)"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = standins.trees(spark, sf_dir)
    t = t.where(carbon.exclusion(F.col("dbh"), F.col("status") == "R").isNull())
    return t.withColumns({"agb": carbon.biomass_with_height(F.col("dbh"), F.col("height")), "basal": carbon.basal_area(F.col("dbh"))})


@query(f"WITH {standins.TREES}, k AS (SELECT CASE WHEN status = 'R' THEN 'dead' WHEN dbh < 5 THEN 'small' ELSE 'counted' END AS reason FROM trees) SELECT reason, count(*) AS n FROM k GROUP BY reason")
def tree_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = standins.trees(spark, sf_dir)
    reason = F.coalesce(carbon.exclusion(F.col("dbh"), F.col("status") == "R"), F.lit("counted"))
    return t.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {standins.TREES} SELECT plot, count(*) AS trees, round(sum(pi() / 4 * (dbh / 100) * (dbh / 100)), 6) AS basal, round(sum({AGB}) / 1000, 6) AS agb, round(sqrt(sum(dbh * dbh) / count(*)), 6) AS qmd FROM trees WHERE status <> 'R' AND dbh >= 5 GROUP BY plot")
def plot_biomass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees, basal area, biomass in tonnes and quadratic mean diameter of plots."""
    return _counted(spark, sf_dir).groupBy("plot").agg(F.count("*").alias("trees"), F.round(F.sum("basal"), 6).alias("basal"), F.round(F.sum("agb") / 1000, 6).alias("agb"), F.round(F.sqrt(F.sum(F.col("dbh") * F.col("dbh")) / F.count("*")), 6).alias("qmd"))


@query(f"WITH {standins.TREES} SELECT species, count(*) AS trees, round(avg(dbh), 6) AS dbh, round(sum({AGB}) / 1000, 4) AS agb FROM trees WHERE status <> 'R' AND dbh >= 5 GROUP BY species")
def species_biomass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).groupBy("species").agg(F.count("*").alias("trees"), F.round(F.avg("dbh"), 6).alias("dbh"), F.round(F.sum("agb") / 1000, 4).alias("agb"))


@query(f"WITH {standins.TREES} SELECT {classes.ladder_sql('dbh', classes.DIAMETER)} AS class, count(*) AS trees, round(sum(exp(-1.499 + 2.148 * ln(dbh) + 0.207 * ln(dbh) ** 2 - 0.0281 * ln(dbh) ** 3) * 0.57) / 1000, 4) AS agb FROM trees GROUP BY ALL")
def diameter_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees and biomass by the moist equation for each diameter class."""
    t = standins.trees(spark, sf_dir)
    agb = carbon.biomass_by_climate(F.col("dbh"), "moist")
    return t.groupBy(classes.ladder(F.col("dbh"), classes.DIAMETER).alias("class")).agg(F.count("*").alias("trees"), F.round(F.sum(agb) / 1000, 4).alias("agb"))


ZONES = ("rain", "moist", "dry", "shrub", "mountain", "broadleaf", "conifer")
RULES = ", ".join(f"('{z}', {a}, {b}, {str(c).lower()}, {r})" for z, a, b, c, r in carbon.ROOTS)
STOCK = "SELECT o_orderkey, list_value(" + ", ".join(f"'{z}'" for z in ZONES) + ")[1 + o_custkey % 7] AS zone, round(o_totalprice / 1000) AS agb, 0.1 * (o_orderkey % 9 + 1) AS area FROM orders"
RATIO = f"rules AS (SELECT * FROM (VALUES {RULES}) t(zone, low, high, closed, ratio)), stock AS ({STOCK}), rooted AS (SELECT s.*, (SELECT arg_min(ratio, low) FROM rules r WHERE r.zone = s.zone AND agb >= low AND (agb < high OR closed AND agb = high)) AS ratio FROM stock s)"


def _rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = F.array(*[F.lit(z) for z in ZONES])
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.get(zones, (F.col("o_custkey") % 7).cast("int")).alias("zone"), F.round(F.col("o_totalprice") / 1000).alias("agb"), (0.1 * (F.col("o_orderkey") % 9 + 1)).alias("area"))
    return carbon.root_ratio(o, "zone", "agb")


@query(f"WITH {RATIO} SELECT zone, count(*) AS n, round(avg(CAST(ratio AS DOUBLE)), 6) AS ratio, min(CAST(ratio AS DOUBLE)) AS least, max(CAST(ratio AS DOUBLE)) AS most FROM rooted GROUP BY zone")
def root_shoot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rooted(spark, sf_dir).groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("ratio"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))


@query(f"WITH {RATIO} SELECT zone, round(sum(CAST(area AS DOUBLE) * (agb * (1 + CAST(ratio AS DOUBLE)) - 0.2 * agb * (1 + CAST(ratio AS DOUBLE))) * 0.47 * 44 / 12), 3) AS co2, round(sum(CAST(area AS DOUBLE) * agb) / sum(CAST(area AS DOUBLE)), 6) AS mean_agb FROM rooted GROUP BY zone")
def emissions_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CO2 of losses that leave a fifth of the biomass, and the area-weighted mean biomass."""
    x = _rooted(spark, sf_dir).withColumn("co2", carbon.emissions(F.col("area"), F.col("agb"), 0.2 * F.col("agb"), F.col("ratio")))
    return x.groupBy("zone").agg(F.round(F.sum("co2"), 3).alias("co2"), F.round(F.sum(F.col("area") * F.col("agb")) / F.sum("area"), 6).alias("mean_agb"))


MATRIX = "m AS (SELECT CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'O' END AS mapped, l_linestatus AS reference, count(*) AS n FROM lineitem GROUP BY ALL)"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "F").otherwise("O").alias("mapped"), F.col("l_linestatus").alias("reference"))
    return carbon.error_matrix(x, "mapped", "reference")


@query(f"WITH {MATRIX} SELECT * FROM m")
def error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query(f"""
WITH {MATRIX}, a AS (SELECT * FROM (VALUES ('F', 250.0), ('O', 750.0)) t(mapped, area)), r AS (SELECT mapped, sum(n) AS ni FROM m GROUP BY mapped),
p AS (SELECT m.mapped, reference, area / 1000 * n / ni AS p, n / ni AS f, (area / 1000) ** 2 * (n / ni) * (1 - n / ni) / (ni - 1) AS v FROM m JOIN r ON m.mapped = r.mapped JOIN a ON a.mapped = m.mapped)
SELECT reference AS class, round(CAST(max(CASE WHEN mapped = reference THEN f END) AS DOUBLE), 6) AS user, round(CAST(sum(CASE WHEN mapped = reference THEN p ELSE 0 END) / sum(p) AS DOUBLE), 6) AS producer,
round(CAST(sum(p) * 1000 AS DOUBLE), 6) AS area, round(CAST(sqrt(sum(v)) * 1000 AS DOUBLE), 6) AS se FROM p GROUP BY reference""")
def stratified_area_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = spark.createDataFrame([("F", 250.0), ("O", 750.0)], "mapped string, area double")
    x = carbon.area_estimates(_matrix(spark, sf_dir), areas)
    return x.select("class", *[F.round(c, 6).alias(c) for c in ("user", "producer", "area", "se")])


@query("""
WITH p AS (SELECT s_suppkey, CAST(count(*) AS DOUBLE) AS x, sum(l_quantity) / 20 AS y FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey), r AS (SELECT sum(y) / sum(x) AS r, avg(x) AS mx, count(*) AS n FROM p)
SELECT n, round(r, 8) AS r, round(sum((y - r * x) ** 2) / ((n - 1) * n * mx * mx), 12) AS variance FROM p, r GROUP BY n, r, mx""")
def ratio_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("x"), (F.sum("l_quantity") / 20).alias("y"))
    return carbon.ratio_estimate(p, "x", "y").select("n", F.round("r", 8).alias("r"), F.round("variance", 12).alias("variance"))


@query()
def mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean biomass of plots by Student's interval; the quantile has no SQL form."""
    x = _counted(spark, sf_dir).groupBy("plot", (F.col("plot") % 5).alias("zone")).agg((F.sum("agb") / 1000).alias("agb"))
    return carbon.mean_interval(x, "agb", "zone").select("zone", "n", *[F.round(c, 6).alias(c) for c in ("mean", "se", "half")])


RINGS = [("a", 0, 0, 2.0, 1.5), ("a", 0, 1, 40.3, 6.5), ("a", 0, 2, 30.7, 90.5), ("a", 0, 3, 5.1, 60.5), ("a", 1, 0, 12.2, 20.5), ("a", 1, 1, 22.2, 20.5), ("a", 1, 2, 22.2, 40.5), ("a", 1, 3, 12.2, 40.5), ("b", 0, 0, 35.2, 100.5), ("b", 0, 1, 60.1, 130.5), ("b", 0, 2, 15.4, 160.5)]


@query(f"""
WITH {standins.GRID}, v AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {r}, {i}, {x}, {y})" for p, r, i, x, y in RINGS)}) t(polygon, ring, i, x, y)),
e AS (SELECT polygon, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY polygon, ring ORDER BY i)),
c AS (SELECT polygon, row, col, z FROM grid, e WHERE (y1 > row) <> (y2 > row) AND col < (x2 - x1) * (row - y1) / (y2 - y1) + x1),
k AS (SELECT polygon, row, col, z FROM c GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT polygon, count(*) AS cells, round(avg(z), 8) AS mean FROM k GROUP BY polygon""")
def zonal_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose centre is in a polygon, holes left out, and their mean."""
    rings = spark.createDataFrame(RINGS, "polygon string, ring int, i int, x double, y double")
    g = standins.grid(spark, sf_dir)
    hit = vector.points_in_polygons(g.select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y")), rings, 10.0)
    x = g.join(hit, (g.col == hit.x) & (g.row == hit.y))
    return x.groupBy("polygon").agg(F.count("*").alias("cells"), F.round(F.avg("z"), 8).alias("mean"))


@query(f"""
WITH v AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {r}, {i}, {x}, {y})" for p, r, i, x, y in RINGS)}) t(polygon, ring, i, x, y)),
e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY polygon, ring ORDER BY i))
SELECT polygon, CAST(ring AS INT) AS ring, count(*) AS vertices, round(CAST(abs(sum(x * ny - nx * y)) / 2 AS DOUBLE), 6) AS area, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 6) AS perimeter FROM e GROUP BY polygon, ring""")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = spark.createDataFrame(RINGS, "polygon string, ring int, i int, x double, y double")
    return vector.ring_areas(rings, "polygon", "ring").select("polygon", "ring", "vertices", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"))


@query("""
WITH c AS (SELECT c_custkey % 180 - 90 AS south FROM customer GROUP BY ALL), q AS (SELECT south, sin(radians(south)) AS s, sin(radians(south + 1)) AS n, sqrt(CAST(0.00669437999014 AS DOUBLE)) AS e FROM c),
a AS (SELECT south, (1 - e * e) * (s / (1 - e * e * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) AS qs, (1 - e * e) * (n / (1 - e * e * n * n) - ln((1 - e * n) / (1 + e * n)) / (2 * e)) AS qn, (1 - e * e) * (1 / (1 - e * e) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp FROM q)
SELECT CAST(south AS BIGINT) AS south, round(CAST(6371007.1809 AS DOUBLE) * 6371007.1809 * radians(1) * abs(qn - qs) / qp / 1e6, 4) AS km2 FROM a""")
def authalic_cell_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of a one-degree cell for each latitude."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 180 - 90).alias("south")).distinct()
    return c.select("south", F.round(vector.cell_area(F.col("south") + 1.0, F.col("south").cast("double"), F.lit(1.0)) / 1e6, 4).alias("km2"))


@query("""
WITH p AS (SELECT c_custkey % 360 - 179.5 AS lon, c_acctbal / 200 AS lat FROM customer), t AS (SELECT least(greatest(floor((lon + 180) / 360 * 64), 0), 63) AS x, least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 64), 0), 63) AS y FROM p)
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, count(*) AS n FROM t GROUP BY ALL""")
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in each web map tile at zoom 6."""
    c = table(spark, sf_dir, "customer")
    x, y = vector.tile_of(F.col("c_custkey") % 360 - 179.5, F.col("c_acctbal") / 200, 6)
    return c.groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))
