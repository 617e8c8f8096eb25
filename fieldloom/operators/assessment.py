"""Accuracy of maps from stratified samples: labels joined, sample sizes, accuracies and areas with their standard errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.dist import t_975

# Fixed value: the normal quantile of a 95 % interval.
Z_95 = 1.959964


def cochran(weight: Column, user_accuracy: float = 0.8, se: float = 0.01) -> Column:
    """Sample size for a standard error of the overall accuracy; an aggregate over strata of the given weights."""
    return F.ceil(F.pow(F.sum(weight) * F.sqrt(F.lit(user_accuracy * (1 - user_accuracy))) / se, F.lit(2.0)))


def labelled(points: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """points (id, mapped) with reference, the class of the label of the same id. A label is a class's name in either case or its number.

    points without a label keep a null; unknown is true where a label is neither. names: class, name."""
    known = names.select(F.col("class"), F.explode(F.array(F.lower(F.trim("name")), F.col("class").cast("string"))).alias("text")).dropDuplicates(["text"])
    given = labels.select("id", F.lower(F.trim(F.col("label").cast("string"))).alias("text")).where("text <> ''")
    x = points.join(given, "id", "left").join(F.broadcast(known), "text", "left")  # names are the map's classes, 255 at most
    return x.select("id", "mapped", F.col("class").alias("reference"), (F.col("text").isNotNull() & F.col("class").isNull()).alias("unknown"))


def accuracies(matrix: DataFrame, areas: DataFrame) -> DataFrame:
    """By class: samples, user's and producer's accuracy, area, and the half widths of their 95 % intervals. matrix: mapped, reference, n; areas: mapped, area.

    A class that no point was mapped to has no user's accuracy; a stratum of one point adds no variance. Rows are classes, so all tables are small."""
    whole = areas.agg(F.sum("area").alias("whole"))
    rows = matrix.groupBy("mapped").agg(F.sum("n").alias("ni"), F.sum(F.when(F.col("mapped") == F.col("reference"), F.col("n")).otherwise(0)).alias("hits"))
    strata = areas.crossJoin(F.broadcast(whole)).join(rows, "mapped", "left").withColumns({"w": F.col("area") / F.col("whole"), "user": F.try_divide("hits", "ni")})
    spare = F.when(F.col("ni") > 1, F.col("ni") - 1)
    strata = strata.withColumns({"spare": spare, "user_var": F.col("user") * (1 - F.col("user")) / spare})
    every = matrix.select(F.col("reference").alias("class")).union(areas.select("mapped")).distinct()
    f = F.col("n") / F.col("ni")
    cell = matrix.join(strata, "mapped").withColumns({"p": F.col("w") * f, "cell_area": F.col("area") * f, "v": F.col("w") * F.col("w") * f * (1 - f) / F.col("spare"), "other": F.when(F.col("mapped") != F.col("reference"), F.col("area") * F.col("area") * f * (1 - f) / F.col("spare"))})
    zero = F.lit(0.0)
    ref = cell.groupBy(F.col("reference").alias("class")).agg(F.sum("p").alias("share"), F.coalesce(F.sum("v"), zero).alias("var"), F.sum("cell_area").alias("est"), F.coalesce(F.sum("other"), zero).alias("others"), F.sum(F.when(F.col("mapped") == F.col("reference"), F.col("p")).otherwise(0.0)).alias("hit"))
    own = strata.select(F.col("mapped").alias("class"), "area", "ni", "user", "user_var")
    x = every.crossJoin(F.broadcast(whole)).join(own, "class", "left").join(ref, "class", "left").withColumn("producer", F.try_divide("hit", "share"))
    a2 = F.col("area") * F.col("area") * F.pow(1 - F.col("producer"), F.lit(2.0)) * F.col("user_var")
    producer_var = (F.coalesce(a2, zero) + F.col("producer") * F.col("producer") * F.col("others")) / (F.col("est") * F.col("est"))
    half = lambda v: Z_95 * F.sqrt(v)
    return x.select(
        "class", F.coalesce("ni", F.lit(0)).alias("samples"), "user", half(F.col("user_var")).alias("user_half"), "producer", half(producer_var).alias("producer_half"),
        (F.coalesce("share", zero) * F.col("whole")).alias("area"), (half(F.coalesce("var", zero)) * F.col("whole")).alias("area_half"),
    )


def overall(matrix: DataFrame, areas: DataFrame) -> DataFrame:
    """One row: samples, overall accuracy weighted by area, and the half width of its 95 % interval."""
    rows = matrix.groupBy("mapped").agg(F.sum("n").alias("ni"), F.sum(F.when(F.col("mapped") == F.col("reference"), F.col("n")).otherwise(0)).alias("hits"))
    whole = areas.agg(F.sum("area").alias("whole"))
    x = rows.join(areas, "mapped").crossJoin(F.broadcast(whole)).withColumns({"w": F.col("area") / F.col("whole"), "u": F.col("hits") / F.col("ni")})
    v = F.when(F.col("ni") > 1, F.col("w") * F.col("w") * F.col("u") * (1 - F.col("u")) / (F.col("ni") - 1)).otherwise(0.0)
    return x.agg(F.sum("ni").alias("samples"), F.sum(F.col("w") * F.col("u")).alias("overall"), (Z_95 * F.sqrt(F.sum(v))).alias("half"))


def ratio_total(ratio: DataFrame, detected: float) -> DataFrame:
    """The total of a ratio estimate (n, r, variance) over all detected units with Student's 95 % interval, cut at zero."""
    x = ratio.withColumns({"total": F.col("r") * detected, "se": detected * F.sqrt("variance")})
    half = F.when(F.col("n") >= 2, t_975((F.col("n") - 1).cast("double")) * F.col("se"))
    return x.withColumn("half", half).select("n", "r", "total", "se", F.greatest(F.lit(0.0), F.col("total") - F.col("half")).alias("low"), (F.col("total") + F.col("half")).alias("high"))
