"""Grids onto other grids by computed keys: nearest cell, and bilinear weights; and holes filled from the nearest cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def target_cells(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def nearest(target: DataFrame, source: DataFrame, value: str, down: float, across: float) -> DataFrame:
    """The source cell in which each target cell's centre lies. down, across: source cells to a target cell."""
    at = target.withColumns({"r": F.floor((F.col("row") + 0.5) * down).cast("int"), "c": F.floor((F.col("col") + 0.5) * across).cast("int")})
    return at.join(source.select(F.col("row").alias("r"), F.col("col").alias("c"), value), ["r", "c"], "left").select("row", "col", value)


def bilinear(target: DataFrame, source: DataFrame, value: str, down: float, across: float) -> DataFrame:
    """Weighted mean of the four source cells around each centre; cells that are missing or off the grid leave their weight to the others."""
    y, x = (F.col("row") + 0.5) * down - 0.5, (F.col("col") + 0.5) * across - 0.5
    t = target.withColumns({"y0": F.floor(y), "x0": F.floor(x), "fy": y - F.floor(y), "fx": x - F.floor(x)})
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    t = t.withColumn("k", F.explode(corner))
    w = F.when(F.col("k.i") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("k.j") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    t = t.select("row", "col", (F.col("y0") + F.col("k.i")).cast("int").alias("r"), (F.col("x0") + F.col("k.j")).cast("int").alias("c"), w.alias("w"))
    s = source.where(F.col(value).isNotNull()).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("v"))
    return t.join(s, ["r", "c"]).where("w > 0").groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))


def nearest_filled(cells: DataFrame, value: str) -> DataFrame:
    """row, col, value and source_row, source_col of every cell: its own value, or that of the nearest cell that has one; of equally near ones the first in scan order. Null where no cell has a value.

    Exact in two passes: along rows, windows find the nearest known cell of the row on both sides; down a column, each cell takes the best of what
    the rows found, looking no farther than its best so far. A group is one column. Cells that the table lacks get no row, but
    they hide nothing behind them.
    """
    v = F.col(value).cast("double")
    given = cells.select("row", "col", F.when(~F.isnan(v), v).alias("v"), F.lit(True).alias("here"))
    low, high = given.agg(F.min("col"), F.max("col")).first()
    if low is None:
        return given.select("row", "col", F.col("v").alias(value), F.col("row").alias("source_row"), F.col("col").alias("source_col"))
    x = given.select("row").distinct().withColumn("col", F.explode(F.sequence(F.lit(low), F.lit(high)))).join(given, ["row", "col"], "left")
    known = F.when(F.col("v").isNotNull(), F.struct("col", "v"))
    across = W.partitionBy("row").orderBy("col")
    x = x.withColumns({"l": F.last(known, ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, 0)), "r": F.first(known, ignorenulls=True).over(across.rowsBetween(0, W.unboundedFollowing))})
    left = F.col("r").isNull() | (F.col("col") - F.col("l.col") <= F.col("r.col") - F.col("col"))
    own = F.when(F.col("l").isNotNull() & left, F.col("l")).otherwise(F.col("r"))
    x = x.select("row", "col", "here", own.alias("s")).select("row", "col", F.coalesce("here", F.lit(False)).alias("here"), F.col("s.col").cast("double").alias("c"), F.col("s.v").alias("v"))

    def down(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("row")
        first, last = int(p.row.iloc[0]), int(p.row.iloc[-1])
        n = last - first + 1
        grid = np.full((3, n), np.nan)  # source row, source column and value found so far
        at = p.row.to_numpy() - first
        grid[:, at] = np.where(np.isnan(p.c), np.nan, p.row), p.c, p.v
        rows, col = np.arange(first, last + 1.0), float(p.col.iloc[0])
        start, apart = grid.copy(), (grid[1] - col) ** 2
        best = np.where(np.isnan(apart), np.inf, apart)
        step = 1
        while step < n and (best >= step * step).any():
            for to, source in ((slice(step, n), slice(0, n - step)), (slice(0, n - step), slice(step, n))):
                far = step * step + (start[1, source] - col) ** 2
                earlier = (start[0, source] < grid[0, to]) | ((start[0, source] == grid[0, to]) & (start[1, source] < grid[1, to]))
                nearer = (far < best[to]) | ((far == best[to]) & earlier)
                best[to] = np.where(nearer, far, best[to])
                grid[:, to] = np.where(nearer, start[:, source], grid[:, to])
            step += 1
        at = at[p.here.to_numpy()]
        found = pd.DataFrame({"row": rows[at], "col": int(col), "v": grid[2, at], "source_row": grid[0, at], "source_col": grid[1, at]})
        return found.astype({"row": "int32", "col": "int32", "source_row": "Int32", "source_col": "Int32"})

    out = x.groupBy("col").applyInPandas(down, "row int, col int, v double, source_row int, source_col int")
    return out.select("row", "col", F.when(~F.isnan("v"), F.col("v")).alias(value), "source_row", "source_col")
