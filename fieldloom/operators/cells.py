"""Rasters as tables of cells: row, col and values. Masks, indices, classes, areas, joins of dates, and neighbourhoods on dense grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scene classes that are masked, and bits of the quality word.
MASKED_SCENE_CLASSES = (0, 1, 3, 8, 9, 10, 11)
QA_BITS = 63


def no_data(v: Column, missing: float | None = None) -> Column:
    x = v.cast("double")
    bad = F.isnan(x) if missing is None else F.isnan(x) | (x == F.lit(missing).cast("float").cast("double"))
    return F.when(~bad, x)


def masked_by_scene(scl: Column) -> Column:
    return scl.isNull() | F.rint(scl).cast("int").isin(*MASKED_SCENE_CLASSES)


def masked_by_bits(qa: Column) -> Column:
    return qa.isNull() | (F.rint(qa).cast("int").bitwiseAND(QA_BITS) != 0)


def ratio(a: Column, b: Column) -> Column:
    """Normalised difference; null for a zero denominator."""
    return F.try_divide(a - b, a + b)


#: Spectral indices by name; bands are given by role.
INDICES = {
    "NDVI": lambda b: ratio(b["nir"], b["red"]),
    "EVI": lambda b: F.try_divide(2.5 * (b["nir"] - b["red"]), b["nir"] + 6 * b["red"] - 7.5 * b["blue"] + 1),
    "SAVI": lambda b: F.try_divide(1.5 * (b["nir"] - b["red"]), b["nir"] + b["red"] + 0.5),
    "NDWI": lambda b: ratio(b["green"], b["nir"]),
    "NDMI": lambda b: ratio(b["nir"], b["swir1"]),
    "NBR": lambda b: ratio(b["nir"], b["swir2"]),
    "NDBI": lambda b: ratio(b["swir1"], b["nir"]),
}


def index(name: str, **bands: Column) -> Column:
    return INDICES[name](bands)


def loss_classes(before: Column, after: Column, forest: float, loss: float) -> Column:
    """1 stable forest, 2 loss, 3 gain, 4 other; 0 unobserved. loss is negative."""
    d = after - before
    return F.when(before.isNull() | after.isNull(), 0).when((before >= forest) & (d <= loss), 2).when((before < forest) & (d >= -loss), 3).when(before >= forest, 1).otherwise(4)


def water_classes(before: Column, after: Column, threshold: float) -> Column:
    """1 dry, 2 water at both dates, 3 new, 4 gone; 0 unobserved."""
    a, b = before >= threshold, after >= threshold
    return F.when(before.isNull() | after.isNull(), 0).when(a & b, 2).when(b, 3).when(a, 4).otherwise(1)


def radar_change(before: Column, after: Column, threshold: float) -> Column:
    """Classes of the log ratio in decibels: 1 falls, 2 stays, 3 rises; 0 where a power isn't positive."""
    d = 10 * F.log10(F.try_divide(after, before))
    return F.when((before <= 0) | (after <= 0) | before.isNull() | after.isNull(), 0).when(d <= -threshold, 1).when(d >= threshold, 3).otherwise(2)


def class_totals(cells: DataFrame, cls: str, area: Column) -> DataFrame:
    return cells.groupBy(F.col(cls).alias("class")).agg(F.count("*").alias("cells"), F.sum(area).alias("area"))


def block_means(cells: DataFrame, value: str, size: int, rows: int) -> DataFrame:
    """Means of size x size blocks; null below half of a full block, which at the lower edge counts the rows that are there."""
    by, bx = F.floor(F.col("row") / size), F.floor(F.col("col") / size)
    x = cells.groupBy(by.cast("int").alias("block_row"), bx.cast("int").alias("block_col")).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    full = F.least(F.lit(size), F.lit(rows) - F.col("block_row") * size) * size
    return x.select("block_row", "block_col", "n", F.when(F.col("n") >= full / 2, F.col("m")).alias("mean"))


def neighbourhood(cells: DataFrame, value: str) -> DataFrame:
    """The nine values around each cell as columns a to i, row by row; null where there is no such cell or the one between is absent. Two windows instead of nine joins."""
    across, down = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")
    before = lambda c, w, k: F.when(F.lag(k).over(w) == F.col(k) - 1, F.lag(c).over(w))
    after = lambda c, w, k: F.when(F.lead(k).over(w) == F.col(k) + 1, F.lead(c).over(w))
    x = cells.withColumns({"l": before(value, across, "col"), "e": F.col(value), "r": after(value, across, "col")})
    up = {k: before(s, down, "row") for k, s in (("a", "l"), ("b", "e"), ("c", "r"))}
    low = {k: after(s, down, "row") for k, s in (("g", "l"), ("h", "e"), ("i", "r"))}
    return x.withColumns(up | low).withColumnsRenamed({"l": "d", "r": "f"})


def horn(n: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Slope in degrees, aspect (compass degrees, null when flat below 2 degrees) and hillshade from neighbourhood(); null at the border."""
    c = {k: F.col(k) for k in "abcdefghi"}
    east = ((c["c"] + 2 * c["f"] + c["i"]) - (c["a"] + 2 * c["d"] + c["g"])) / (8 * dx)
    south = ((c["g"] + 2 * c["h"] + c["i"]) - (c["a"] + 2 * c["b"] + c["c"])) / (8 * dy)
    whole = c["e"].isNotNull()
    for k in "abcdfghi":
        whole = whole & c[k].isNotNull()
    x = n.withColumns({"gx": F.when(whole, east), "gy": F.when(whole, south)})
    slope = F.degrees(F.atan(F.hypot("gx", "gy")))
    compass = F.pmod(450 - F.degrees(F.atan2(F.col("gy"), -F.col("gx"))), F.lit(360.0))
    x = x.withColumns({"slope": slope, "compass": compass})
    zenith, sun = F.radians(F.lit(45.0)), F.radians(F.lit((360.0 - 315 + 90) % 360))
    facing = F.when((F.col("gx") == 0) & (F.col("gy") == 0), 0.0).otherwise(F.atan2(F.col("gy"), -F.col("gx")))
    rad = F.radians("slope")
    shade = F.greatest(F.lit(0.0), F.cos(zenith) * F.cos(rad) + F.sin(zenith) * F.sin(rad) * F.cos(sun - facing))
    return x.withColumns({"aspect": F.when(F.col("slope") >= 2, F.col("compass")), "shade": F.when(F.col("slope").isNotNull(), shade)})


def mirrored(cells: DataFrame, margin: int) -> DataFrame:
    """The cells and, beyond each edge, copies of the margin's rows and columns, mirrored; grids have at least so many of both. Adds ghost, true for copies."""
    ends = cells.agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))  # one row
    x = cells.crossJoin(F.broadcast(ends)).withColumn("ghost", F.lit(False))
    for c, last in (("row", "last_row"), ("col", "last_col")):
        low, high = F.col(c) < margin, F.col(c) > F.col(last) - margin
        places = F.array_compact(F.array(F.col(c), F.when(low, -1 - F.col(c)), F.when(high, 2 * F.col(last) + 1 - F.col(c))))
        x = x.withColumn("place", F.explode(places)).withColumns({"ghost": F.col("ghost") | (F.col("place") != F.col(c)), c: F.col("place")}).drop("place")
    return x.drop("last_row", "last_col")


def local_mean_variance(cells: DataFrame, value: str, size: int = 5) -> DataFrame:
    """Mean and population variance over size x size cells, mirrored at the grid's edge; missing cells don't count."""
    k = size // 2
    v = F.col(value)
    across = W.partitionBy("row").orderBy("col").rangeBetween(-k, k)
    x = mirrored(cells, k).withColumns({"s1": F.sum(v).over(across), "s2": F.sum(v * v).over(across), "s0": F.count(v).over(across)})
    down = W.partitionBy("col").orderBy("row").rangeBetween(-k, k)
    n, s, q = F.sum("s0").over(down), F.sum("s1").over(down), F.sum("s2").over(down)
    x = x.withColumns({"mean": F.when(n > 0, s / n), "variance": F.when(n > 0, F.greatest(F.lit(0.0), q / n - (s / n) * (s / n)))})
    return x.where(~F.col("ghost")).drop("s0", "s1", "s2", "ghost")


def gaussian(cells: DataFrame, value: str, sigma: float = 0.67) -> DataFrame:
    """Adds smooth, a separable Gaussian over int(4 sigma + 0.5) cells each way, mirrored at the edge. Missing cells weigh in as zeros and stay missing."""
    k = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(k + 1)]
    weights = F.array(*[F.lit(w / (raw[0] + 2 * sum(raw[1:]))) for w in raw])
    x = mirrored(cells, k).withColumn("filled", F.coalesce(F.col(value), F.lit(0.0)))
    for along, other in (("col", "row"), ("row", "col")):
        near = F.collect_list(F.struct(F.col(along).alias("at"), "filled")).over(W.partitionBy(other).orderBy(along).rangeBetween(-k, k))
        here = F.col(along)
        x = x.withColumn("near", near).withColumn("filled", F.aggregate("near", F.lit(0.0), lambda t, n: t + F.get(weights, F.abs(n["at"] - here)) * n["filled"]))  # noqa: B023  used at once
    return x.where(~F.col("ghost")).withColumn("smooth", F.when(F.col(value).isNotNull(), F.col("filled"))).drop("near", "filled", "ghost")


def lee(x: DataFrame, value: str, looks: float = 4.4) -> DataFrame:
    """Speckle filter from local_mean_variance(): the mean, and the cell's departure from it as far as it isn't speckle."""
    m, var = F.col("mean"), F.col("variance")
    b = F.when(var > 0, F.greatest((var - m * m / looks) / (1 + 1 / looks), F.lit(0.0)) / var).otherwise(0.0)
    return x.withColumn("filtered", m + b * (F.col(value) - m))


def local_maxima(cells: DataFrame, value: str, radius: int, least: float) -> DataFrame:
    """Cells above `least` that no cell within the radius exceeds; the first in scan order of equals stays. Neighbours meet by equal blocks of radius cells."""
    x = cells.where(F.col(value) > least).select("row", "col", F.col(value).alias("v"))
    block = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = x.withColumns({"br": block("row"), "bc": block("col")})
    b = x.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("v").alias("v2"), F.explode(near).alias("o")).select("r2", "c2", "v2", (F.floor(F.col("r2") / radius) + F.col("o.i")).alias("br"), (F.floor(F.col("c2") / radius) + F.col("o.j")).alias("bc"))
    inside = (F.col("r2") - F.col("row")) * (F.col("r2") - F.col("row")) + (F.col("c2") - F.col("col")) * (F.col("c2") - F.col("col")) <= radius * radius
    earlier = (F.col("r2") < F.col("row")) | ((F.col("r2") == F.col("row")) & (F.col("c2") < F.col("col")))
    beaten = (F.col("v2") > F.col("v")) | ((F.col("v2") == F.col("v")) & earlier)
    b = b.select(F.col("br").alias("br2"), F.col("bc").alias("bc2"), "r2", "c2", "v2")
    return a.join(b, (F.col("br") == F.col("br2")) & (F.col("bc") == F.col("bc2")) & inside & beaten, "left_anti").select("row", "col", F.col("v").alias(value))


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """The threshold that parts a histogram best; of a run of equally good ones, the middle."""
    v = df.select(F.col(value).alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)))
    h = v.crossJoin(F.broadcast(ends)).where("high > low").groupBy("low", "high", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.where("high > low").select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    h = every.join(h.select("bin", "n"), "bin", "left").fillna(0, ["n"])
    mid = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins
    h = h.withColumns({"mid": mid, "mass": F.col("n") * mid})
    upto, whole = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    h = h.withColumns({"w0": F.sum("n").over(upto), "m0": F.sum("mass").over(upto), "w": F.sum("n").over(whole), "m": F.sum("mass").over(whole)})
    apart = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / (F.col("w") - F.col("w0"))
    h = h.where("w0 > 0 and w0 < w").withColumn("between", F.round(F.col("w0") * (F.col("w") - F.col("w0")) * apart * apart, 6))
    best = h.withColumn("top", F.max("between").over(whole)).where("between = top")
    return best.agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.first("low").alias("low"), F.first("high").alias("high")).select(
        (F.col("low") + ((F.col("first") + F.col("last")) / 2 + 1) * (F.col("high") - F.col("low")) / bins).alias("threshold")
    )
