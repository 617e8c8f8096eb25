"""Whole grids in square tiles with one cell of their neighbours around: filling of depressions, distances, flow to two neighbours by the steepest facet, and what reaches an outlet.

A tile is one row with a padded array, so no task holds more than some tiles, however large the grid. What must cross from tile to
tile travels in rounds, a tile a round at least; only tiles that hear something new work in a round.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.networks import NEIGHBOURS
from fieldloom.session import cut

SIZE = 256
#: The least gradient of filled levels: so much a cell, or this share of a level.
LEAST_STEP, LEAST_SHARE = 1e-6, 1e-12
#: Where fewer than this part of a tile's cells change, they are followed one by one.
FEW = 16


def tiles(cells: DataFrame, value: str, size: int = SIZE) -> DataFrame:
    """tr, tc and z, the padded array (float64 bytes, NaN where there is no value), of each tile with a cell of its own. One shuffle: a cell goes to its tile and to those whose margin it is in."""
    span = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.floor((F.col(c) + k) / size).cast("int")))
    x = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    x = x.withColumn("tr", F.explode(span("row"))).withColumn("tc", F.explode(span("col")))

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        z = np.full((size + 2, size + 2), np.nan)
        z[p.row - key[0] * size + 1, p.col - key[1] * size + 1] = p.v
        own = ~np.isnan(z[1:-1, 1:-1]).all()
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "z": [z.tobytes()]}) if own else pd.DataFrame({"tr": [], "tc": [], "z": []})

    return cut(x.groupBy("tr", "tc").applyInPandas(build, "tr int, tc int, z binary"))


def padded(z: bytes) -> np.ndarray:
    x = np.frombuffer(z, np.float64)
    return x.reshape(math.isqrt(len(x)), -1).copy()


def shifted(x: np.ndarray, i: int, j: int) -> np.ndarray:
    """The values one step (i, j) from the inner cells of a padded array."""
    return x[1 + i : x.shape[0] - 1 + i, 1 + j : x.shape[1] - 1 + j]


def _box(z: np.ndarray) -> tuple[slice, slice]:
    """Where a padded tile has cells of its own, with one row and column around them."""
    here = ~np.isnan(z[1:-1, 1:-1])
    r, c = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
    return slice(r[0], r[-1] + 3), slice(c[0], c[-1] + 3)


def _each(work: DataFrame, run: Callable[[tuple, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """run(key, row) of every tile. Each tile is a group, so a worker holds one at a time; a batch of rows would hold as many as its partition has."""
    return work.groupBy("tr", "tc").applyInPandas(lambda key, p: run(key, p.iloc[0]), schema)


def _cells(key: tuple, size: int, mask: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    r, c = np.nonzero(mask)
    return pd.DataFrame({"row": r + key[0] * size, "col": c + key[1] * size} | {k: v[r, c] for k, v in columns.items()})


# --- Filling.


def relaxed(z: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Padded levels of a tile: the least ones from which water can leave over the tile's cells next to missing ones or over its margin, whose levels are given.

    A cell's level is its value, or that of its lowest neighbour and the least gradient, if that is more. Levels fall from infinity,
    for all cells at once, until none changes; they are the same in whatever order cells are visited. Once few cells change, only those
    around them are looked at.
    """
    box = _box(z)
    v = z[box]
    here = ~np.isnan(v[1:-1, 1:-1])
    edge = here & np.any([np.isnan(shifted(v, i, j)) for i, j in NEIGHBOURS], axis=0)
    whole = around.copy()
    whole[1:-1, 1:-1] = np.inf
    x = np.ascontiguousarray(whole[box])
    x[1:-1, 1:-1] = np.where(edge, v[1:-1, 1:-1], np.inf)
    floor = np.where(here & ~edge, v[1:-1, 1:-1], np.inf)  # cells without a level of their own to find never fall below
    while True:
        up = x + np.maximum(LEAST_STEP, np.abs(x) * LEAST_SHARE)
        low = np.minimum(np.minimum(up[:-2], up[1:-1]), up[2:])
        best = np.minimum(np.minimum(low[:, :-2], low[:, 1:-1]), low[:, 2:])  # a cell's own is above its level, so it changes nothing
        new = np.minimum(np.maximum(floor, best), x[1:-1, 1:-1])
        fell = new < x[1:-1, 1:-1]
        x[1:-1, 1:-1] = new
        if np.count_nonzero(fell) * FEW <= fell.size:
            break
    flat, width = x.ravel(), x.shape[1]
    floor, steps = np.pad(floor, 1, constant_values=np.inf).ravel(), np.array([i * width + j for i, j in NEIGHBOURS])
    near = np.zeros(len(flat), bool)
    at = np.flatnonzero(np.pad(fell, 1))
    while len(at):
        near[(at[:, None] + steps).ravel()] = True
        c = np.flatnonzero(near)
        near[c] = False
        c = c[floor[c] < flat[c]]
        b = flat[c[:, None] + steps].min(axis=1)
        new = np.maximum(floor[c], b + np.maximum(LEAST_STEP, np.abs(b) * LEAST_SHARE))
        fell = new < flat[c]
        at = c[fell]
        flat[at] = new[fell]
    whole[box][1:-1, 1:-1] = x[1:-1, 1:-1]
    return whole


def _part(i: int, n: int, margin: bool) -> slice:
    """Rows (or columns) of a padded array towards step i: those of the margin, or the last ones inside."""
    if i == 0:
        return slice(1, n - 1)
    return (slice(0, 1) if i < 0 else slice(n - 1, n)) if margin else (slice(1, 2) if i < 0 else slice(n - 2, n - 1))


def spread(cells: DataFrame, value: str, within: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = SIZE, rounds: list[int] | None = None) -> DataFrame:
    """row, col, value and level of a whole grid, where within(z, around) gives a tile's padded levels for its values and those of its margin, and levels can only fall.

    Between rounds only levels along the tiles' sides are kept; a tile that hears of lower ones works out its levels again. So rounds are
    as many as tiles follow each other along the way that levels take. rounds, if given, gets how many tiles worked in each.
    """
    grid = tiles(cells, value, size)
    to = ["tr", "tc", "di", "dj"]

    def margins(held: list | np.ndarray, n: int) -> np.ndarray:
        around = np.full((n, n), np.inf)
        for h in held:
            around[_part(h["di"], n, True), _part(h["dj"], n, True)] = np.frombuffer(h["v"], np.float64).reshape(1 if h["di"] else n - 2, 1 if h["dj"] else n - 2)
        return around

    def sides(key: tuple, t: pd.Series) -> pd.DataFrame:
        z, out = padded(t.z), []
        n = len(z)
        x = within(z, margins(t.held, n))
        for i, j in NEIGHBOURS:
            v = x[_part(i, n, False), _part(j, n, False)]
            if np.isfinite(v).any():
                out.append((key[0] + i, key[1] + j, -i, -j, v.tobytes()))
        return pd.DataFrame(out, columns=[*to, "v"])

    def levels(key: tuple, t: pd.Series) -> pd.DataFrame:
        z = padded(t.z)
        own = z[1:-1, 1:-1]
        return _cells(key, size, ~np.isnan(own), v=own, level=within(z, margins(t.held, len(z)))[1:-1, 1:-1])

    def with_held(x: DataFrame, told: DataFrame) -> DataFrame:
        held = told.groupBy("tr", "tc").agg(F.collect_list(F.struct("di", "dj", "v")).alias("held"))  # eight at most
        return x.join(held, ["tr", "tc"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<di:int,dj:int,v:binary>>")))

    told = cut(grid.sparkSession.createDataFrame([], "tr int, tc int, di int, dj int, v binary"))
    work = grid
    while True:
        said = _each(with_held(work, told), sides, "tr int, tc int, di int, dj int, v binary").join(grid.select("tr", "tc"), ["tr", "tc"], "left_semi")
        old = told.select(*to, F.col("v").alias("was"))
        news = cut(said.join(old, to, "left").where(~F.col("v").eqNullSafe(F.col("was"))).drop("was"))
        hear = cut(news.select("tr", "tc").distinct())
        many = hear.count()
        if rounds is not None:
            rounds.append(many)
        if not many:
            break
        told = cut(told.join(news, to, "left_anti").unionByName(news))
        work = grid.join(hear, ["tr", "tc"], "left_semi")
    return _each(with_held(grid, told), levels, "row int, col int, v double, level double").withColumnRenamed("v", value)


def filled(cells: DataFrame, value: str, size: int = SIZE, rounds: list[int] | None = None) -> DataFrame:
    """row, col, value and level of a whole grid: depressions are raised to where water can leave, and a least gradient leads there."""
    return spread(cells, value, relaxed, size, rounds)


#: Steps to a neighbour, along a row or column and along a diagonal, in thirds of a cell.
ALONG, DIAGONAL = 3.0, 4.0


def chamfered(z: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Padded distances, in thirds of a cell, from a tile's cells of value 0 or from its margin, whose distances are given."""
    whole = around.copy()
    whole[1:-1, 1:-1] = np.where(z[1:-1, 1:-1] == 0, 0.0, np.inf)
    box = _box(z)
    x, here = whole[box], ~np.isnan(z[box][1:-1, 1:-1])
    while True:
        best = np.minimum.reduce([shifted(x, i, j) + (DIAGONAL if i and j else ALONG) for i, j in NEIGHBOURS])
        new = np.where(here, np.minimum(x[1:-1, 1:-1], best), np.inf)
        if (new == x[1:-1, 1:-1]).all():
            return whole
        x[1:-1, 1:-1] = new


def depth(cells: DataFrame, inside: str, size: int = SIZE, rounds: list[int] | None = None) -> DataFrame:
    """row, col, inside and depth: how many cells it is, by steps of 1 and 4/3 to neighbours, to the nearest cell that isn't inside; null if no path over cells leads to one."""
    x = spread(cells.withColumn(inside, F.col(inside).cast("int")), inside, chamfered, size, rounds)
    return x.select("row", "col", F.col(inside).cast("boolean").alias(inside), F.when(F.col("level") < float("inf"), F.col("level") / 3).alias("depth"))


# --- Flow by facets.

# The eight facets counter-clockwise from the east: the side neighbour and the corner neighbour (row, col).
FACETS = (((0, 1), (-1, 1)), ((-1, 0), (-1, 1)), ((-1, 0), (-1, -1)), ((0, -1), (-1, -1)), ((0, -1), (1, -1)), ((1, 0), (1, -1)), ((1, 0), (1, 1)), ((0, 1), (1, 1)))


def facets(level: np.ndarray, dx: float = 1.0, dy: float = 1.0) -> dict[str, np.ndarray]:
    """For the inner cells of padded levels: facet (the steepest of eight, the first of equals; -1 if none falls), corner (the share of the flow that goes to its corner neighbour), tangent (its slope) and width (of the cell across the flow).

    A facet's slope is that of the plane through the cell, the side and the corner neighbour, along the direction of flow, which is kept inside the facet.
    """
    here = shifted(level, 0, 0)
    facet, corner, tangent = np.full(here.shape, -1, np.int8), np.zeros(here.shape), np.zeros(here.shape)
    width = np.ones(here.shape)
    for k, ((i1, j1), (i2, j2)) in enumerate(FACETS):
        near, far = (dx, dy) if i1 == 0 else (dy, dx)
        with np.errstate(invalid="ignore"):
            s1, s2 = (here - shifted(level, i1, j1)) / near, (shifted(level, i1, j1) - shifted(level, i2, j2)) / far
            most = math.atan2(far, near)
            angle = np.arctan2(s2, s1)
            straight = (here - shifted(level, i2, j2)) / math.hypot(near, far)
            slope = np.where(angle < 0, s1, np.where(angle > most, straight, np.hypot(s1, s2)))
            better = slope > tangent  # never where a neighbour is missing
        angle = np.clip(angle, 0, most)[better]
        facet[better], tangent[better], corner[better], width[better] = k, slope[better], angle / most, far * np.cos(angle)
    return {"facet": facet, "corner": corner, "tangent": tangent, "width": width}


def _facets(level: np.ndarray, dx: float, dy: float) -> dict[str, np.ndarray]:
    """facets() of a tile, worked out where it has cells."""
    box = _box(level)
    inner = tuple(slice(b.start, b.stop - 2) for b in box)
    shape = (level.shape[0] - 2, level.shape[1] - 2)
    out = {"facet": np.full(shape, -1, np.int8), "corner": np.zeros(shape), "tangent": np.zeros(shape), "width": np.ones(shape)}
    for k, x in facets(level[box], dx, dy).items():
        out[k][inner] = x
    return out


def _shares(level: np.ndarray, dx: float, dy: float) -> tuple[list[int], list[tuple[int, float, int, float] | None], dict]:
    """Cells of a tile (numbers in the padded array) from high to low, and where each one's flow goes: two padded numbers with their shares."""
    f, n = _facets(level, dx, dy), level.shape[1]
    own = np.flatnonzero(~np.isnan(level[1:-1, 1:-1]).ravel())
    at = (own // (n - 2) + 1) * n + own % (n - 2) + 1
    order = np.argsort(-level.ravel()[at], kind="stable")
    side, edge = (np.array([i * n + j for i, j in (p[s] for p in FACETS)]) for s in (0, 1))
    k, p = f["facet"].ravel()[own][order], f["corner"].ravel()[own][order]
    at = at[order]
    flow = zip((at + side[k]).tolist(), (1 - p).tolist(), (at + edge[k]).tolist(), p.tolist(), strict=True)
    return at.tolist(), [x if kk >= 0 else None for x, kk in zip(flow, k.tolist(), strict=True)], f


def passed_down(level: np.ndarray, weight: np.ndarray, dx: float, dy: float) -> tuple[np.ndarray, dict]:
    """Padded sums of the weights (padded) that flow into or through each cell, a tile's cells from high to low; what leaves the tile stands in its margin."""
    order, flow, f = _shares(level, dx, dy)
    total = weight.ravel().tolist()
    for c, to in zip(order, flow, strict=True):
        if to is not None and total[c]:
            a, p, b, q = to
            total[a] += total[c] * p
            total[b] += total[c] * q
    return np.array(total).reshape(level.shape), f


def passed_up(level: np.ndarray, share: np.ndarray, outlet: int, dx: float, dy: float) -> np.ndarray:
    """Padded shares of each cell's flow that reach cells whose shares are given, a tile's cells from low to high; the outlet (a padded number, or -1) takes nothing more."""
    order, flow, _ = _shares(level, dx, dy)
    found = share.ravel().tolist()
    for c, to in zip(reversed(order), reversed(flow), strict=True):
        if to is not None and c != outlet:
            a, p, b, q = to
            found[c] += found[a] * p + found[b] * q
    return np.array(found).reshape(level.shape)


def _told(grid: DataFrame, told: DataFrame) -> DataFrame:
    """Tiles with what they are told: row, col (of the whole grid) and amount. A tile hears of its own cells and its margin alone, so a list is short."""
    own = told.groupBy("tr", "tc").agg(F.collect_list(F.struct("row", "col", "amount")).alias("told"))
    return grid.join(own, ["tr", "tc"])


def _placed(told: list | np.ndarray, key: tuple, n: int) -> np.ndarray:
    x = np.zeros((n, n))
    for t in told:
        x[t["row"] - key[0] * (n - 2) + 1, t["col"] - key[1] * (n - 2) + 1] += t["amount"]
    return x


TOLD = "tr int, tc int, row long, col long, amount double"


def two_way_flow(cells: DataFrame, level: str, dx: float = 1.0, dy: float = 1.0, size: int = SIZE, rounds: list[int] | None = None) -> DataFrame:
    """row, col, level, facet, corner, tangent, upslope (area that flows through the cell, its own included), catchment (upslope area a unit of width across the flow) and wetness.

    Levels must be filled. Flow is linear: each round passes on, inside the tiles that it enters, only what came in the round before, and the
    last step adds up all that ever came. So rounds are as many as tiles follow each other along a path of flow.
    """
    grid = tiles(cells, level, size)
    area = dx * dy

    def out(key: tuple, total: np.ndarray) -> pd.DataFrame:
        total = total.copy()
        total[1:-1, 1:-1] = 0
        r, c = np.nonzero(total)
        row, col = r - 1 + key[0] * size, c - 1 + key[1] * size
        return pd.DataFrame({"tr": row // size, "tc": col // size, "row": row, "col": col, "amount": total[r, c]})

    def first(key: tuple, t: pd.Series) -> pd.DataFrame:
        z = padded(t.z)
        own = np.pad(np.where(np.isnan(z[1:-1, 1:-1]), 0.0, area), 1)
        return out(key, passed_down(z, own, dx, dy)[0])

    def more(key: tuple, t: pd.Series) -> pd.DataFrame:
        z = padded(t.z)
        return out(key, passed_down(z, _placed(t.told, key, len(z)), dx, dy)[0])

    def last(key: tuple, t: pd.Series) -> pd.DataFrame:
        z = padded(t.z)
        own = ~np.isnan(z[1:-1, 1:-1])
        total, f = passed_down(z, np.pad(np.where(own, area, 0.0), 1) + _placed(t.told, key, len(z)), dx, dy)
        return _cells(key, size, own, level=z[1:-1, 1:-1], facet=f["facet"].astype(np.int32), corner=f["corner"], tangent=f["tangent"], upslope=total[1:-1, 1:-1], catchment=total[1:-1, 1:-1] / f["width"])

    news = cut(_each(grid, first, TOLD).groupBy("tr", "tc", "row", "col").agg(F.sum("amount").alias("amount")))
    every = news
    while True:
        many = news.select("tr", "tc").distinct().count()
        if rounds is not None:
            rounds.append(many)
        if not many:
            break
        news = cut(_each(_told(grid, news), more, TOLD).groupBy("tr", "tc", "row", "col").agg(F.sum("amount").alias("amount")))
        every = cut(every.unionByName(news).groupBy("tr", "tc", "row", "col").agg(F.sum("amount").alias("amount")))
    held = every.groupBy("tr", "tc").agg(F.collect_list(F.struct("row", "col", "amount")).alias("told"))
    x = grid.join(held, ["tr", "tc"], "left").withColumn("told", F.coalesce("told", F.array().cast("array<struct<row:bigint,col:bigint,amount:double>>")))
    x = _each(x, last, "row int, col int, level double, facet int, corner double, tangent double, upslope double, catchment double")
    return x.withColumn("wetness", F.log(F.col("catchment") / F.greatest("tangent", F.lit(0.001)))).withColumnRenamed("level", level)


def upslope_share(cells: DataFrame, level: str, outlet: tuple[int, int], dx: float = 1.0, dy: float = 1.0, size: int = SIZE, rounds: list[int] | None = None) -> DataFrame:
    """row, col and share of each cell of whose flow a share reaches the outlet: 1 there; the areas times shares sum to the outlet's upslope area."""
    grid = tiles(cells, level, size)
    row, col = outlet

    def up(key: tuple, t: pd.Series) -> pd.DataFrame:
        (tr, tc), z = key, padded(t.z)
        n = len(z)
        inside = tr == row // size and tc == col // size
        at = (row - tr * size + 1) * n + col - tc * size + 1 if inside else -1
        found = passed_up(z, _placed(t.told, key, n), at, dx, dy)[1:-1, 1:-1]
        return _cells(key, size, found != 0, amount=found).assign(tr=tr, tc=tc)[["tr", "tc", "row", "col", "amount"]]

    def beyond(x: DataFrame) -> DataFrame:
        """What the tiles around hear: cells in their margins."""
        span = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.floor((F.col(c) + k) / size).cast("int")))
        y = x.withColumns({"r2": F.explode(span("row"))}).withColumn("c2", F.explode(span("col"))).where("r2 <> tr or c2 <> tc")
        return y.select(F.col("r2").alias("tr"), F.col("c2").alias("tc"), "row", "col", "amount")

    start = grid.sparkSession.createDataFrame([(row // size, col // size, row, col, 1.0)], TOLD)
    every, told = None, start
    while True:
        found = cut(_each(_told(grid, told), up, TOLD))
        many = found.select("tr", "tc").distinct().count()
        if rounds is not None:
            rounds.append(many)
        if not many:
            break
        every = found if every is None else cut(every.unionByName(found).groupBy("tr", "tc", "row", "col").agg(F.sum("amount").alias("amount")))
        told = beyond(found)
    if every is None:
        return grid.sparkSession.createDataFrame([], "row int, col int, share double")
    return every.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("amount").alias("share"))
