"""Tree biomass, plot totals, roots, emissions, and estimates from samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.dist import t_975

# Default wood density (g/cm3), least diameter (cm), carbon fraction, CO2 per carbon, largest plausible diameter.
DENSITY, LEAST_DBH, CARBON, CO2, LARGEST_DBH = 0.57, 5.0, 0.47, 44 / 12, 212.0
# Intercept and slope of the height-free equations by climate.
CLIMATES = {"dry": (-0.667, 1.784), "moist": (-1.499, 2.148), "wet": (-1.239, 1.98)}
# Root-to-shoot ratios: zone, from biomass, to biomass, whether the upper bound belongs, ratio.
ROOTS = (
    ("rain", 0.0, 1e9, False, 0.37),
    ("moist", 0.0, 125.0, False, 0.20),
    ("moist", 125.0, 1e9, False, 0.24),
    ("dry", 0.0, 20.0, False, 0.56),
    ("dry", 20.0, 1e9, False, 0.28),
    ("shrub", 0.0, 1e9, False, 0.40),
    ("mountain", 0.0, 1e9, False, 0.27),
    ("broadleaf", 0.0, 75.0, False, 0.46),
    ("broadleaf", 75.0, 150.0, True, 0.23),
    ("broadleaf", 150.0, 1e9, False, 0.24),
    ("conifer", 0.0, 50.0, False, 0.40),
    ("conifer", 50.0, 150.0, True, 0.29),
    ("conifer", 150.0, 1e9, False, 0.20),
)


def biomass_with_height(dbh: Column, height: Column, density: Column | float = DENSITY) -> Column:
    """Above-ground biomass of a tree in kg."""
    return 0.0673 * F.pow(density * dbh * dbh * height, F.lit(0.976))


def biomass_by_stress(dbh: Column, density: Column | float, stress: Column | float) -> Column:
    """From an environmental stress index instead of a height."""
    rho = F.lit(density) if isinstance(density, float) else density
    e = F.lit(stress) if isinstance(stress, float) else stress
    return F.exp(-1.803 - 0.976 * e + 0.976 * F.ln(rho) + 2.673 * F.ln(dbh) - 0.0299 * F.pow(F.ln(dbh), F.lit(2.0)))


def biomass_by_climate(dbh: Column, climate: str, density: Column | float = DENSITY) -> Column:
    a, b = CLIMATES[climate]
    x = F.ln(dbh)
    return density * F.exp(a + b * x + 0.207 * x * x - 0.0281 * x * x * x)


def basal_area(dbh: Column) -> Column:
    """Square metres."""
    return F.pi() / 4 * (dbh / 100) * (dbh / 100)


def exclusion(dbh: Column, dead: Column) -> Column:
    """Why a tree isn't counted; null if it is."""
    return F.when(dead, "dead").when(dbh.isNull(), "no diameter").when(dbh < LEAST_DBH, "small").when(dbh > LARGEST_DBH, "large")


def root_ratio(df: DataFrame, zone: str, biomass: str) -> DataFrame:
    """Adds the root-to-shoot ratio by zone and biomass (tonnes a hectare); null outside all ranges. The 13 ranges are a projection, so rows stay where and as often as they are."""
    found = [F.when((df[zone] == z) & (df[biomass] >= low) & ((df[biomass] < high) | (F.lit(closed) & (df[biomass] == high))), ratio) for z, low, high, closed, ratio in ROOTS]
    # A closed bound and the next range's lower bound both take the bound itself: the closed one, which comes first, counts.
    return df.withColumn("ratio", F.coalesce(*found).cast("double"))


def emissions(area: Column, before: Column, after: Column, ratio: Column) -> Column:
    """Tonnes of CO2 of a loss: area times the difference of biomass with roots."""
    return area * (before * (1 + ratio) - after * (1 + ratio)) * CARBON * CO2


def mean_interval(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, standard error and the half width of Student's 95 % interval; null below two values."""
    x = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    return x.withColumn("half", F.when(F.col("n") >= 2, t_975((F.col("n") - 1).cast("double")) * F.col("se")))


def error_matrix(df: DataFrame, mapped: str, reference: str) -> DataFrame:
    return df.groupBy(F.col(mapped).alias("mapped"), F.col(reference).alias("reference")).agg(F.count("*").alias("n"))


def area_estimates(matrix: DataFrame, areas: DataFrame) -> DataFrame:
    """By class: user's and producer's accuracy, area and standard error from a stratified sample. areas: mapped, area."""
    whole = areas.agg(F.sum("area").alias("whole"))
    w = areas.crossJoin(F.broadcast(whole)).select("mapped", (F.col("area") / F.col("whole")).alias("w"), "whole")
    rows = matrix.groupBy("mapped").agg(F.sum("n").alias("n_i"))
    p = matrix.join(rows, "mapped").join(w, "mapped").withColumns({"p": F.col("w") * F.col("n") / F.col("n_i"), "f": F.col("n") / F.col("n_i")})
    p = p.withColumn("v", F.when(F.col("n_i") > 1, F.col("w") * F.col("w") * F.col("f") * (1 - F.col("f")) / (F.col("n_i") - 1)).otherwise(0.0))
    by = p.groupBy(F.col("reference").alias("class"), "whole").agg(F.sum("p").alias("share"), F.sum("v").alias("var"), F.sum(F.when(F.col("mapped") == F.col("reference"), F.col("p")).otherwise(0.0)).alias("hit"), F.max(F.when(F.col("mapped") == F.col("reference"), F.col("f"))).alias("user"))
    return by.select("class", F.coalesce("user", F.lit(0.0)).alias("user"), F.try_divide("hit", "share").alias("producer"), (F.col("share") * F.col("whole")).alias("area"), (F.sqrt("var") * F.col("whole")).alias("se"))


def ratio_estimate(df: DataFrame, x: str, y: str) -> DataFrame:
    """R = sum(y) / sum(x) over plots with its variance and n."""
    r = df.agg((F.sum(y) / F.sum(x)).alias("r"), F.avg(x).alias("mean_x"), F.count("*").alias("n"))
    e = df.crossJoin(F.broadcast(r))
    return e.groupBy("n", "r", "mean_x").agg(F.sum(F.pow(F.col(y) - F.col("r") * F.col(x), F.lit(2.0))).alias("ss")).select("n", "r", (F.col("ss") / ((F.col("n") - 1) * F.col("n") * F.col("mean_x") * F.col("mean_x"))).alias("variance"))
