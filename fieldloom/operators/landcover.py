"""Land cover: k-means and random forests on band columns, and Monte Carlo emissions. Spark's own learners do the work."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators.carbon import CARBON, CO2


def _free(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has them."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n = f"_{n}"
        out.append(n)
    return out


def clusters(cells: DataFrame, bands: list[str], k: int, rank_by: str, keys: list[str], most: int = 20_000, seed: int = 7) -> DataFrame:
    """Classes 1 to k of all cells whose bands are all there, ranked by the mean of a band. The model is fitted on at most `most` cells, those with the least seeded hash."""
    whole = cells.dropna(subset=bands)
    raw, x, c, m = _free([*cells.columns, "class"], "raw", "x", "c", "m")
    vec = VectorAssembler(inputCols=bands, outputCol=raw).transform(whole)
    train = vec.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(most)
    scaler = StandardScaler(inputCol=raw, outputCol=x, withMean=True).fit(train)
    model = KMeans(k=k, seed=seed, featuresCol=x, predictionCol=c).fit(scaler.transform(train))
    labelled = model.transform(scaler.transform(vec))
    order = labelled.groupBy(c).agg(F.avg(rank_by).alias(m)).select(c, F.row_number().over(W.orderBy(m, c)).alias("class"))  # k rows
    return labelled.join(F.broadcast(order), c).drop(raw, x, c)


def forest(train: DataFrame, cells: DataFrame, bands: list[str], label: str, trees: int = 100, per_class: int = 5000, seed: int = 7, depth: int = 10) -> DataFrame:
    """Predicted class of all cells from training cells, at most per_class of each class by seeded hash."""
    rank = F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), *bands), *bands))
    x, y, k, p, raw, prob = _free([*train.columns, *cells.columns], "x", "y", "k", "p", "raw", "prob")
    own = train.dropna(subset=[*bands, label]).withColumn(k, rank).where(F.col(k) <= per_class)
    names = [r[0] for r in own.select(label).distinct().orderBy(label).collect()]  # classes
    codes = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, float(i))])
    vec = VectorAssembler(inputCols=bands, outputCol=x)
    learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol=x, labelCol=y, predictionCol=p, rawPredictionCol=raw, probabilityCol=prob)
    model = learner.fit(vec.transform(own.withColumn(y, codes[F.col(label)])))
    out = model.transform(vec.transform(cells.dropna(subset=bands)))
    return out.withColumn("predicted", F.get(F.array(*[F.lit(n) for n in names]), F.col(p).cast("int"))).drop(x, raw, prob, p)


def folds(shapes: DataFrame, label: str, shape: str, most: int = 5, seed: int = 7) -> DataFrame:
    """A fold for each training shape, stratified by class; a shape is never split. As many folds as the rarest class has shapes, `most` at most."""
    own = shapes.select(label, shape).distinct()
    k = own.groupBy(label).agg(F.count("*").alias("n")).agg(F.least(F.lit(most), F.min("n")).alias("k"))
    rank = F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), shape), shape))
    return own.withColumn("r", rank - 1).crossJoin(F.broadcast(k)).select(label, shape, (F.col("r") % F.col("k")).cast("int").alias("fold"))


def emission_draws(df: DataFrame, draws: int = 20_000, seed: int = 7) -> DataFrame:
    """zone, low, median and high (2.5, 50, 97.5 %) of emissions. df: zone, area, agb, ratio and their standard deviations (area_sd, agb_sd, ratio_sd), a row a zone; negative draws count as 0."""
    d = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    n = lambda c, s: F.greatest(F.lit(0.0), F.col(c) + F.randn(seed + s) * F.col(f"{c}_sd"))
    e = n("area", 0) * n("agb", 1) * (1 + n("ratio", 2)) * CARBON * CO2
    q = F.percentile("e", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return d.withColumn("e", e).groupBy("zone").agg(q.alias("q")).select("zone", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))
