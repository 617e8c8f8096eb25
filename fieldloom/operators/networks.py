"""Graph-shaped operators on grids: patches, minimum units, flow and stream orders. Loops cut their lineage in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.session import cut

# Neighbours in the order of flow directions, NW, N, NE, W, E, SW, S, SE.
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def around(cells: DataFrame, *columns: str) -> DataFrame:
    """Each cell's row and col with those of its 8 neighbours (r2, c2) and the neighbour's number."""
    near = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(NEIGHBOURS)])
    return cells.select("row", "col", *columns, F.explode(near).alias("n")).select("row", "col", *columns, F.col("n.k").alias("k"), (F.col("row") + F.col("n.i")).alias("r2"), (F.col("col") + F.col("n.j")).alias("c2"))


def patches(cells: DataFrame, width: int) -> DataFrame:
    """row, col and patch of the given cells: 8-connected, numbered by their least cell (row * width + col). Labels spread by least neighbour and by pointer jumping, so long patches need few rounds."""
    x = cut(cells.select("row", "col", (F.col("row").cast("long") * width + F.col("col")).alias("id")))
    edges = around(x, "id").join(x.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("id").alias("to")), ["r2", "c2"]).select("id", "to")
    edges = cut(edges)
    labels = x.select("id", F.col("id").alias("patch"))
    while True:
        least = edges.join(labels.select(F.col("id").alias("to"), "patch"), "to").groupBy("id").agg(F.min("patch").alias("least"))
        near = labels.join(least, "id", "left").select("id", F.col("patch").alias("was"), F.least("patch", F.coalesce("least", "patch")).alias("patch"))
        pulled = near.groupBy(F.col("was").alias("id")).agg(F.min("patch").alias("pull"))
        near = cut(near.join(pulled, "id", "left").select("id", "was", F.least("patch", F.coalesce("pull", "patch")).alias("patch")))
        jumped = cut(near.join(near.select(F.col("id").alias("patch"), F.col("patch").alias("over")), "patch").select("id", "was", F.least("patch", "over").alias("patch")))
        labels = jumped.select("id", "patch")
        if not jumped.where("patch <> was").limit(1).count():
            return x.join(labels, "id").select("row", "col", "patch")


def minimum_units(labelled: DataFrame, area: Column, least: float) -> DataFrame:
    """Patches with their cells and area, and whether they reach the minimum unit."""
    return labelled.groupBy("patch").agg(F.count("*").alias("cells"), F.sum(area).alias("area")).withColumn("kept", F.col("area") >= least)


def flow_direction(cells: DataFrame, value: str) -> DataFrame:
    """Number of the neighbour with the steepest descent (the first of equals), -1 where none is lower."""
    there = cells.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col(value).alias("v2"))
    length = F.when(F.col("r2").eqNullSafe(F.col("row")) | F.col("c2").eqNullSafe(F.col("col")), 1.0).otherwise(F.sqrt(F.lit(2.0)))
    slope = (F.col(value) - F.col("v2")) / length
    x = around(cells, value).join(there, ["r2", "c2"]).where(slope > 0)
    best = x.groupBy("row", "col").agg(F.max_by("k", F.struct(F.round(slope, 9), -F.col("k"))).alias("direction"))
    return cells.join(best, ["row", "col"], "left").select("row", "col", value, F.coalesce("direction", F.lit(-1)).alias("direction"))


def downstream(directed: DataFrame, width: int) -> DataFrame:
    """Edges id -> to of the flow graph; outlets have no edge."""
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])
    x = directed.where("direction >= 0").withColumn("s", F.get(step, F.col("direction")))
    return x.select((F.col("row").cast("long") * width + F.col("col")).alias("id"), ((F.col("row") + F.col("s.i")).cast("long") * width + F.col("col") + F.col("s.j")).alias("to"))


def flow_accumulation(ids: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """id and all weight that flows through it, its own included. Doubling: after round k each weight has met the next 2^k cells, so rounds are the logarithm of the longest path."""
    total = cut(ids.select("id", F.col(weight).cast("double").alias("own"), F.col(weight).cast("double").alias("total")))
    jump = cut(edges.select("id", "to"))
    while jump.limit(1).count():
        passed = total.join(jump, "id").groupBy("to").agg(F.sum("total").alias("more")).withColumnRenamed("to", "id")
        total = cut(total.join(passed, "id", "left").select("id", "own", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")))
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to"))
    return total.select("id", "total")


def strahler(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """id and stream order of the cells: 1 at sources, one more where two of the highest order meet. Cells are peeled from the sources down, a round for each step; chains.stream_orders contracts what lies between junctions first."""
    inflow = cut(edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("inflows")))
    ready = cut(cells.select("id").join(inflow, "id", "left_anti").withColumn("order", F.lit(1)))
    known = ready
    while True:
        # How many of each order flow in, then those of the highest one.
        met = edges.join(known, "id").groupBy(F.col("to").alias("id"), "order").agg(F.count("*").alias("c"))
        met = met.groupBy("id").agg(F.sum("c").alias("n"), F.max("order").alias("most"), F.max_by("c", "order").alias("tops"))
        new = met.join(inflow, "id").where("n = inflows").join(known, "id", "left_anti").select("id", (F.col("most") + (F.col("tops") >= 2).cast("int")).alias("order"))
        new = cut(new)
        if not new.limit(1).count():
            return known
        known = cut(known.union(new))


def dilate(cells: DataFrame, radius: int) -> DataFrame:
    """All cells within a square of the radius around the given ones."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    return cells.select(F.explode(F.transform(steps, lambda i: F.col("row") + i)).alias("row"), "col").select("row", F.explode(F.transform(steps, lambda j: F.col("col") + j)).alias("col")).distinct()


def ranked_largest(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows, a report, by falling values with their rank; only they meet in one place."""
    return df.orderBy(F.desc(by), *order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(F.desc(by), *order)))


def wetness(total: Column, tangent: Column) -> Column:
    """Topographic wetness: the logarithm of the upslope area over the slope's tangent, which counts as 0.001 at least."""
    return F.log(total / F.greatest(tangent, F.lit(0.001)))


def emit_alerts(cells: DataFrame, width: int, area: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """Alerts, a row for each patch of confirmed cells not yet reported that reaches the least area (patch, cells, area, row, col: its centre), and the cells with
    reported brought up to date. Smaller patches wait and may grow. cells: row, col, confirmed, reported."""
    waiting = cells.where("confirmed and not reported")
    labelled = patches(waiting, width)
    p = labelled.withColumn("a", area).groupBy("patch").agg(F.count("*").alias("cells"), F.sum("a").alias("area"), F.avg("row").alias("row"), F.avg("col").alias("col")).where(F.col("area") >= least)
    told = labelled.join(p.select("patch"), "patch", "left_semi").select("row", "col", F.lit(True).alias("told"))
    after = cells.join(told, ["row", "col"], "left").withColumn("reported", F.col("reported") | F.coalesce("told", F.lit(False))).drop("told")
    return p, after
