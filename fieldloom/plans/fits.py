"""Fits of a few passes, tree tops and distances over the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import canopy, fits, regrid, tiles
from fieldloom.plans.registry import query, table
from fieldloom.sources import standins

HIGHEST = f"WITH {standins.GRID}, t AS (SELECT row, col, z * 60 AS h FROM grid)"


@query(f"""{HIGHEST}, c AS (SELECT *, greatest(1, CAST(floor((3.75105 - 0.17919 * h + 0.01241 * h * h) / 2 / 0.8 + 0.5) AS INT)) AS radius FROM t WHERE h >= 8),
lost AS (SELECT DISTINCT c.row, c.col FROM c JOIN t ON t.row BETWEEN c.row - 6 AND c.row + 6 AND t.col BETWEEN c.col - 6 AND c.col + 6 AND (t.row - c.row) ** 2 + (t.col - c.col) ** 2 <= c.radius ** 2 AND (t.row <> c.row OR t.col <> c.col) AND (t.h > c.h OR (t.h = c.h AND (t.row < c.row OR (t.row = c.row AND t.col < c.col)))))
SELECT row, col, round(h, 6) AS h, radius FROM c ANTI JOIN lost USING (row, col)""")
def tree_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tops that no cell in the crown expected of their height exceeds."""
    x = standins.grid(spark, sf_dir).select("row", "col", (F.col("z") * 60).alias("h"))
    return canopy.tree_tops(x, "h", 8.0, 0.8).select("row", "col", F.round("h", 6).alias("h"), "radius")


@query(f"""WITH {standins.GRID}, o AS (SELECT row, col FROM grid WHERE z <= -0.05), k AS (SELECT unnest(range(-9, 10)) AS i), near AS (SELECT o.row + a.i AS row, o.col + b.i AS col, min((4 * least(abs(a.i), abs(b.i)) + 3 * abs(abs(a.i) - abs(b.i))) / 3.0::DOUBLE) AS depth FROM o, k a, k b GROUP BY ALL)
SELECT g.row, g.col, z > -0.05 AS inside, round(depth, 6) AS depth FROM grid g LEFT JOIN near n ON n.row = g.row AND n.col = g.col""")
def depth_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each cell is from the nearest low one."""
    x = standins.grid(spark, sf_dir).select("row", "col", (F.col("z") > -0.05).alias("inside"))
    return tiles.depth(x, "inside").select("row", "col", "inside", F.round("depth", 6).alias("depth"))


def _alike(table_: str, a: str, b: str, name: str) -> str:
    """The passes of the line between two columns, one after the other."""
    parts, use, last = [], "true", None
    for k in range(4):
        fit = f"{name}{k}"
        gain = "CASE WHEN var_pop(a) * count(*) > 1e-9 THEN covar_pop(a, b) / var_pop(a) ELSE 1 END"
        source = f"(SELECT {a} AS a, {b} AS b FROM {table_})" + (f", {last}" if last else "")
        parts.append(f"{fit}s AS (SELECT {gain} AS gain, avg(b) - {gain} * avg(a) AS off FROM {source} WHERE {use})")
        parts.append(f"{fit}m AS (SELECT gain, off, median({b} - gain * {a} - off) AS mid FROM {table_}, {fit}s GROUP BY gain, off)")
        parts.append(f"{fit} AS (SELECT gain, off, mid, greatest(1e-6, 1.4826 * median(abs({b} - gain * {a} - off - mid))) AS spread FROM {table_}, {fit}m GROUP BY gain, off, mid)")
        use, last = f"abs(b - {fit}.gain * a - {fit}.off - {fit}.mid) < 2.5 * {fit}.spread", fit
    parts.append(f"{name} AS (SELECT gain, off, greatest(spread, (SELECT (max({b}) - min({b})) * 0.01 FROM {table_}), 1e-6) AS spread FROM {last})")
    return ", ".join(parts)


#: Two dates of two bands.
BANDS = f"{standins.TWO_DATES}, img AS (SELECT a.row, a.col, a.before AS a1, a.after * 0.2 + a.before * 0.8 AS b1, b.before AS a2, b.after * 0.1 + b.before * 0.9 AS b2 FROM two a JOIN two b ON b.row = a.row AND b.col = a.col + 32)"


@query(f"""WITH {BANDS}, {_alike('img', 'a1', 'b1', 'f')}, {_alike('img', 'a2', 'b2', 'g')},
m AS (SELECT row, col, sqrt((((b1 - f.gain * a1 - f.off) / f.spread) ** 2 + ((b2 - g.gain * a2 - g.off) / g.spread) ** 2) / 2) AS magnitude FROM img, f, g),
d AS (SELECT median(magnitude) AS mid FROM m), s AS (SELECT greatest(2.5, any_value(mid) + 2.0 * greatest(1.4826 * median(abs(magnitude - mid)), 0.25)) AS most FROM m, d)
SELECT row, col, round(magnitude, 6) AS magnitude, magnitude > most AS changed FROM m, s""")
def image_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change between two dates of two bands, each made alike first."""
    t = standins.two_dates(spark, sf_dir)
    b = t.select("row", (F.col("col") - 32).alias("col"), F.col("before").alias("a2"), (F.col("after") * 0.1 + F.col("before") * 0.9).alias("b2"))
    x = t.select("row", "col", F.col("before").alias("a1"), (F.col("after") * 0.2 + F.col("before") * 0.8).alias("b1")).join(b, ["row", "col"])
    return fits.change_magnitude(x, [("a1", "b1"), ("a2", "b2")], 2.0)[0].select("row", "col", F.round("magnitude", 6).alias("magnitude"), "changed")


PLOTS = "plots AS (SELECT p_partkey, 4 + p_size AS h, (4 + p_size) * sqrt(4 + p_size) * (0.7 + (p_partkey % 13) / 20.0) AS m FROM part), l AS (SELECT *, ln(h) AS x, ln(m) AS y FROM plots)"


@query(f"""WITH {PLOTS}, f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS la, avg(x) AS mx, var_pop(x) AS xx, var_pop(y) AS yy, min(h) AS low, max(h) AS high FROM l),
s AS (SELECT f.*, sum((y - la - b * x) ** 2) AS ss FROM l, f GROUP BY ALL),
e AS (SELECT s.*, y - la - b * x AS r, 1 - 1.0 / n - (x - mx) ** 2 / (n * xx) AS rest, x, y, m FROM l, s)
SELECT any_value(n) AS plots, round(exp(any_value(ss) / (any_value(n) - 2) / 2 + any_value(la)), 9) AS a, round(any_value(b), 9) AS b, round(sqrt(any_value(ss) / (any_value(n) - 2)), 9) AS spread, round(1 - any_value(ss) / (any_value(n) * any_value(yy)), 9) AS r2,
round(sqrt(avg((exp(ss / (n - 2) / 2 + la + b * x) - m) ** 2)), 6) AS rmse, round(sqrt(avg((exp((ss - r * r / rest) / (n - 3) / 2 + y - r / rest) - m) ** 2)), 6) AS loo_rmse FROM e""")
def biomass_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of biomass by canopy height over parts as plots; one row."""
    h = 4 + F.col("p_size")
    p = table(spark, sf_dir, "part").select(h.alias("h"), (h * F.sqrt(h) * (0.7 + (F.col("p_partkey") % 13) / 20.0)).alias("m"))
    f = fits.height_model(p, "h", "m")
    return spark.createDataFrame([(f["plots"], *[round(f[k], 9) for k in ("a", "b", "spread", "r2")], *[round(f[k], 6) for k in ("rmse", "loo_rmse")])], "plots long, a double, b double, spread double, r2 double, rmse double, loo_rmse double")


@query()
def biomass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's biomass over the grid with its interval by draws; one row. Tests hold the interval against draws cell by cell."""
    h = 4 + F.col("p_size")
    p = table(spark, sf_dir, "part").select(h.alias("h"), (h * F.sqrt(h) * (0.7 + (F.col("p_partkey") % 13) / 20.0)).alias("m"))
    grid = standins.grid(spark, sf_dir).select((F.col("z") * 60).alias("h"), F.lit(0.04).alias("ha"))
    return spark.createDataFrame([{k: float(v) for k, v in fits.total_biomass(fits.height_model(p, "h", "m"), grid, "h", "ha").items()}])


@query()
def water_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the grid's values, if they have two clear parts, and why; one row. Tests hold the gate against known mixtures."""
    found, why = fits.gated_threshold(standins.grid(spark, sf_dir), "z", (-0.3, 0.3), 0.0)
    return spark.createDataFrame([(found, why)], "threshold double, why string")


@query(f"""WITH {standins.GRID}, h AS (SELECT row, col, CASE WHEN (row * 7 + col * 13) % 11 >= 5 AND NOT (row % 50 BETWEEN 20 AND 27 AND col BETWEEN 20 AND 30) THEN z END AS z FROM grid),
k AS (SELECT h.row, h.col, o.z, row_number() OVER (PARTITION BY h.row, h.col ORDER BY (o.row - h.row) ** 2 + (o.col - h.col) ** 2, o.row, o.col) AS n, o.row AS source_row, o.col AS source_col FROM h JOIN h o ON o.z IS NOT NULL AND o.row BETWEEN h.row - 7 AND h.row + 7 AND o.col BETWEEN h.col - 7 AND h.col + 7)
SELECT row, col, round(z, 6) AS z, source_row, source_col FROM k WHERE n = 1""")
def holes_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with holes, each filled from the nearest cell that has a value."""
    hole = ((F.col("row") * 7 + F.col("col") * 13) % 11 < 5) | ((F.col("row") % 50).between(20, 27) & F.col("col").between(20, 30))
    x = standins.grid(spark, sf_dir).select("row", "col", F.when(~hole, F.col("z")).alias("z"))
    return regrid.nearest_filled(x, "z").select("row", "col", F.round("z", 6).alias("z"), "source_row", "source_col")
