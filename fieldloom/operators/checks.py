"""Checks and small relational operators: sanity of values, order of times, budgets, nearest cells, clear scenes, retention, small parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share_outside(v: Column, low: float, high: float) -> Column:
    """An aggregate: the share of values that leave a range, among those there are."""
    return F.avg(F.when(v.isNotNull(), (~v.between(low, high)).cast("int")))


def all_codes(v: Column, most: int) -> Column:
    """An aggregate: whether all values are whole numbers from 0 to most."""
    return F.coalesce(F.bool_and((v == F.floor(v)) & v.between(0, most)), F.lit(True))


def out_of_order(df: DataFrame, time: str, position: str, *keys: str) -> DataFrame:
    """keys and unordered: whether any time is before the last one that stands earlier in its file; missing times are skipped."""
    before = F.last(time, ignorenulls=True).over(W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("before", before).groupBy(*keys).agg(F.coalesce(F.bool_or(F.col(time) < F.col("before")), F.lit(False)).alias("unordered"))


def orders_within(lines: DataFrame, order: str, points: str, budget: int) -> DataFrame:
    """The highest whole stream orders whose lines fit the budget of points; the first that overflows ends the list. A row for each order."""
    x = lines.groupBy(order).agg(F.count("*").alias("lines"), F.sum(points).alias("points"))
    return x.withColumn("total", F.sum("points").over(W.orderBy(F.desc(order)))).where(F.col("total") <= budget)


def nearest_best(cells: DataFrame, value: str, row: int, col: int, radius: int) -> DataFrame:
    """The cell of the greatest value within the radius of a place, the first in scan order of equals: where an outlet snaps to."""
    near = F.col("row").between(row - radius, row + radius) & F.col("col").between(col - radius, col + radius)
    return cells.where(near & F.col(value).isNotNull()).orderBy(F.desc(value), "row", "col").limit(1)


def clearest(scenes: DataFrame, cloud: str, order: list[str], most: int = 6) -> DataFrame:
    """The scenes with the least cloud; unknown cloud counts as 100."""
    return scenes.orderBy(F.coalesce(F.col(cloud), F.lit(100.0)), *order).limit(most)


def every_step(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every k-th row of an order, so that at most `most` rows remain for a report."""
    from fieldloom.operators.stats import positions

    step = F.greatest(F.lit(1), F.ceil(F.col("rows") / most))
    return positions(df, order).where(F.col("position") % step == 0).drop("rows")


def _last(values: tuple[str, ...]) -> list[Column]:
    """Aggregates: the values of the row of the greatest number. One value needs no struct, so that Spark can add it up in a hash table."""
    if len(values) == 1:
        return [F.max_by(values[0], "number").alias(values[0])]
    s = F.max_by(F.struct(*values), "number")
    return [s[v].alias(v) for v in values]


def last_of_place(shapes: DataFrame, place: list[str], *values: str) -> DataFrame:
    """place, number and values of the last of the shapes that cover the same cells, as their equal place tells: no other one of them is seen anywhere."""
    return shapes.groupBy(*place).agg(F.max("number").alias("number"), *_last(values))


def last_shape_wins(cells: DataFrame, shapes: DataFrame, inside: Column, *values: str) -> DataFrame:
    """row, col and the values of the shape of the greatest number among those that cover a cell. `inside` is the condition of the join, with an equality on tiles."""
    hit = cells.join(shapes, inside)
    return hit.groupBy("row", "col").agg(*_last(values))


def regrid_mean(cells: DataFrame, value: str, factor: int) -> DataFrame:
    """row and col of a grid of cells `factor` times as large, with the mean of the small cells that have a value."""
    big = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return cells.groupBy(big("row"), big("col")).agg(F.avg(value).alias(value), F.count(value).alias("cells"))


def small_values(m: Column, most: int = 500) -> Column:
    """A map without the values of more than `most` characters."""
    return F.map_filter(m, lambda _, v: F.length(v) <= most)


def retained(rows: DataFrame, at: str, now: Column, kind: str, days: dict[str, int]) -> DataFrame:
    """Rows that are not older than their kind's number of days; kinds without one stay for good."""
    limit = F.lit(None).cast("int")
    for k, d in days.items():
        limit = F.when(F.col(kind) == k, F.lit(d)).otherwise(limit)
    return rows.where(limit.isNull() | (F.col(at) >= now - F.make_dt_interval(limit)))


def answers(df: DataFrame, value: str, position: str, *keys: str) -> DataFrame:
    """n, mean, the highest and the lowest value and their positions, the first of equals; missing values don't count."""
    x = df.where(F.col(value).isNotNull()).groupBy(*keys)
    return x.agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("highest"), F.max_by(position, F.struct(value, -F.col(position))).alias("highest_at"),
        F.min(value).alias("lowest"), F.min_by(position, F.struct(value, position)).alias("lowest_at"),
    )
