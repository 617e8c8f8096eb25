"""Chains: elements that each have one successor at most and one predecessor at most, put in order by pointer jumping; and what needs them: contours, rings of patches and stream lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators.networks import NEIGHBOURS
from fieldloom.session import cut


#: Numbers of cells that are a block: in it chains are followed in one task.
BLOCK = 1 << 14


def followed(ids: np.ndarray, far: np.ndarray, headed: np.ndarray) -> dict[str, np.ndarray]:
    """For the elements of a block, each with the one before it (far; headed: it has none): part (the first element of its stretch inside the block, or the least of a ring inside), offset (from there), ring, and least and least_at: the stretch's least element and its offset."""
    order = np.argsort(ids)
    ids, far, headed, n = ids[order], far[order], headed[order], len(ids)
    at = np.minimum(np.searchsorted(ids, far), n - 1)
    first = headed | (ids[at] != far)
    back = np.where(first, np.arange(n), at)
    ring, offset, jump = np.zeros(n, bool), (~first).astype(np.int64), back
    for _ in range(n.bit_length() + 1):
        offset, jump = offset + offset[jump], jump[jump]
    for i in np.flatnonzero(~first[jump]):  # from small to large, so a ring is met at its least element first
        if not ring[i]:
            around = [i]
            while (j := back[around[-1]]) != i:
                around.append(j)
            # These go backwards from the first one.
            ring[around], jump[around], offset[around] = True, i, np.append(0, np.arange(len(around) - 1, 0, -1))
    own = np.lexsort((offset, jump))
    starts = np.flatnonzero(np.diff(jump[own], prepend=-1))
    least = np.empty(n, np.int64)
    least[jump[own][starts]] = np.minimum.reduceat(own, starts)  # elements are sorted, so the least has the least number
    least = least[jump]
    return {"id": ids, "far": far, "headed": headed, "first": first, "part": ids[jump], "offset": offset, "ring": ring, "least": ids[least], "least_at": offset[least]}


def ranked_by_blocks(links: DataFrame, block: Callable[[Column], Column], rounds: list[int] | None = None) -> DataFrame:
    """ranked() for links of numbers: stretches of chains inside a block of numbers are followed in one task each, and only stretches that go on in other blocks meet in rounds. A block must hold few enough elements for a task."""
    back = links.select(F.col("next").cast("long").alias("id"), F.col("id").cast("long").alias("far"))
    heads = links.select(F.col("id").cast("long").alias("id")).join(back.select("id"), "id", "left_anti").withColumn("far", F.lit(None).cast("long"))
    every = back.unionByName(heads).select(block(F.col("id")).alias("block"), "id", F.coalesce("far", F.lit(0)).alias("far"), F.col("far").isNull().alias("headed"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(followed(p.id.to_numpy(), p.far.to_numpy(), p.headed.to_numpy()))

    x = cut(every.groupBy("block").applyInPandas(run, "id long, far long, headed boolean, first boolean, part long, offset long, ring boolean, least long, least_at long"))
    before = x.select(F.col("id").alias("far"), F.col("part").alias("part2"), (F.col("offset") + 1).alias("long"), F.col("least").alias("least2"), F.col("least_at").alias("at2"))
    ends = x.where("first")
    go_on = ends.where("not headed").select("id", "far").join(before, "far")
    start = go_on.select("id", F.col("part2").alias("far"), F.col("long").alias("steps"), F.lit(None).cast("long").alias("head"), F.least("id", "least2").alias("least"), F.when(F.col("least2") < F.col("id"), F.col("long") - F.col("at2")).otherwise(0).cast("long").alias("away"))
    begin = ends.where("headed").select("id", F.lit(None).cast("long").alias("far"), F.lit(0).cast("long").alias("steps"), F.col("id").alias("head"), F.col("id").alias("least"), F.lit(0).cast("long").alias("away"))
    met = _jumped(cut(begin.unionByName(start)), rounds).select(F.col("id").alias("part"), "chain", "place", F.col("ring").alias("whole"))
    y = x.where("not ring").join(met, "part")
    inside = F.col("whole") & (F.col("least") == F.col("chain")) & (F.col("least_at") <= F.col("offset"))
    y = y.select("id", "chain", F.when(inside, F.col("offset") - F.col("least_at")).otherwise(F.col("place") + F.col("offset")).alias("place"), F.col("whole").alias("ring"))
    return y.unionByName(x.where("ring").select("id", F.col("part").alias("chain"), F.col("offset").alias("place"), "ring"))


def ranked(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """id, chain, place (from 0) and ring of every element of the links (id, next). An open chain is known by its first element, a ring begins at its least one.

    Each element points back; a round doubles how far, so that rounds grow with the logarithm of the longest chain. Elements of
    a ring never come to a first one; they carry the least element met and how far back it stands, until that changes no more.
    An element in two links of one kind isn't allowed. rounds, if given, gets the open elements of each round.
    """
    back = links.select(F.col("next").alias("id"), F.col("id").alias("far"))
    first = links.select("id").join(back.select("id"), "id", "left_anti").withColumn("far", F.lit(None).cast(links.schema["id"].dataType))
    x = back.unionByName(first).withColumns({"steps": F.when(F.col("far").isNull(), 0).otherwise(1).cast("long"), "head": F.when(F.col("far").isNull(), F.col("id")), "least": F.least("id", "far")})
    return _jumped(cut(x.withColumn("away", F.when(F.col("far") < F.col("id"), 1).otherwise(0).cast("long"))), rounds)


def _jumped(x: DataFrame, rounds: list[int] | None) -> DataFrame:
    """The rounds of ranked()."""
    while True:
        there = x.select(F.col("id").alias("far"), F.col("far").alias("far2"), F.col("steps").alias("steps2"), F.col("head").alias("head2"), F.col("least").alias("least2"), F.col("away").alias("away2"))
        y = x.where("head is null").join(there, "far")
        nearer = F.col("least2") < F.col("least")
        # Where the element behind has come to its first one, far stays there, and so does the number of steps.
        y = y.select("id", F.coalesce("far2", "far").alias("far"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("head2").alias("head"), F.least("least", "least2").alias("least"), F.when(nearer, F.col("steps") + F.col("away2")).otherwise(F.col("away")).alias("away"), nearer.alias("moved"))
        y = cut(y)
        state = y.agg(F.count("*").alias("n"), F.count_if(F.expr("moved or head is not null")).alias("moved")).first()
        if rounds is not None:
            rounds.append(state.n)
        ready = x.where("head is not null")  # those behind them still ask for them
        if not state.moved:
            break
        x = cut(y.drop("moved").unionByName(ready))
    out = ready.select("id", F.col("head").alias("chain"), F.col("steps").alias("place"), F.lit(False).alias("ring"))
    return out.unionByName(y.select("id", F.col("least").alias("chain"), F.col("away").alias("place"), F.lit(True).alias("ring")))


# --- Contours.

#: Corners of a cell between four cell centres, clockwise from the upper left, as (row, col).
CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))


def contour_links(cells: DataFrame, value: str, levels: Sequence[float], width: int) -> DataFrame:
    """level, id and next (crossings of a level with lines between centres of neighbouring cells) and both crossings' x, y, so that the high side is on the right.

    A crossing is known by twice the first cell's number (row * width + col), and one more if the other cell is below. x and y count from
    the grid's upper left corner, centres at halves. Squares that lack a corner have none. Saddles go by the mean of the corners.
    """
    v = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) <> double('inf')")
    spread = F.array(*[F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.lit(k).alias("k")) for k, (i, j) in enumerate(CORNERS)])
    squares = v.select(F.explode(spread).alias("s"), "v").groupBy("s.row", "s.col").agg(*[F.max(F.when(F.col("s.k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)]).dropna()
    corner = [F.col(f"v{k}") for k in range(4)]
    own = F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda x: (x > F.least(*corner)) & (x <= F.greatest(*corner)))
    x = squares.withColumn("level", F.explode(own))
    high = [F.col(f"v{k}") >= F.col("level") for k in range(4)]
    number = lambda i, j: (F.col("row") + i) * width + F.col("col") + j
    keys = [2 * number(0, 0), 2 * number(0, 1) + 1, 2 * number(1, 0), 2 * number(0, 0) + 1]
    # Interpolated from the first corner on the way round, but for the lower and the left side, which their neighbours see the other way.
    part = lambda a, b: F.try_divide(F.col("level") - corner[a], corner[b] - corner[a])
    left, top = F.col("col") + 0.5, F.col("row") + 0.5
    points = [(left + part(0, 1), top), (left + 1, top + part(1, 2)), (left + part(3, 2), top + 1), (left, top + part(0, 3))]
    side = lambda k: F.struct(keys[k].alias("key"), points[k][0].alias("x"), points[k][1].alias("y"))
    rising, falling = [~high[k] & high[(k + 1) % 4] for k in range(4)], [high[k] & ~high[(k + 1) % 4] for k in range(4)]
    saddle = (high[0] == high[2]) & (high[1] == high[3])
    joined = sum(corner) / 4 >= F.col("level")
    # A falling side goes to the rising side after it; in a saddle whose middle is low, to the one before it.
    links = []
    for k in range(4):
        after = F.when(rising[(k + 1) % 4], side((k + 1) % 4)).when(rising[(k + 2) % 4], side((k + 2) % 4)).otherwise(side((k + 3) % 4))
        to = F.when(saddle & ~joined, side((k + 3) % 4)).otherwise(after)
        links.append(F.when(falling[k], F.struct(side(k).alias("a"), to.alias("b"))))
    x = x.select("level", F.explode(F.array_compact(F.array(*links))).alias("s"))
    return x.select("level", F.col("s.a.key").alias("id"), F.col("s.b.key").alias("next"), F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y"), F.col("s.b.x").alias("next_x"), F.col("s.b.y").alias("next_y"))


def contour_points(cells: DataFrame, value: str, levels: Sequence[float], width: int) -> DataFrame:
    """level, line (its least crossing), place, x, y and ring: the points of all contour lines in order. A ring begins at its least crossing and comes back to it with one more point."""
    links = cut(contour_links(cells, value, levels, width))
    # Crossings of all levels as numbers: the level's place, and the crossing.
    place = F.array_position(F.array(*[F.lit(float(v)) for v in levels]), F.col("level")) - 1
    number = lambda c: (place * (1 << 48) + F.col(c)).alias("id")
    order = ranked_by_blocks(links.select(number("id"), number("next").alias("next")), lambda c: F.floor(c / (2 * BLOCK)))
    points = links.select(number("id"), "level", F.col("id").alias("key"), "x", "y").unionByName(links.select(number("next"), "level", F.col("next").alias("key"), F.col("next_x").alias("x"), F.col("next_y").alias("y")))
    points = points.groupBy("id", "level", "key").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    x = cut(order.join(points, "id"))
    lines = x.groupBy("chain", "ring").agg(F.min("key").alias("line"), F.count("*").alias("n"))
    # The number of rows of one line is no matter here: the join is by point.
    x = x.join(lines, ["chain", "ring"])
    places = F.when(F.col("ring") & (F.col("place") == 0), F.array(F.col("place"), F.col("n"))).otherwise(F.array("place"))
    return x.select("level", "line", F.explode(places).alias("place"), "x", "y", "ring")


def nice_interval(relief: float, lines: int = 10) -> float:
    """1, 2 or 5 times a power of ten that gives about so many lines over the relief."""
    if not relief > 0:
        return 1.0
    power = 10.0 ** np.floor(np.log10(relief / lines))
    return float(power * (1, 2, 5, 10)[int(np.searchsorted((1.5, 3.5, 7.5), relief / lines / power, side="right"))])


def interval_levels(low: float, high: float, interval: float, most: int = 60) -> list[float]:
    """The multiples of the interval from low to high, no more than `most`."""
    first = int(np.ceil(low / interval))
    return [round(k * interval, 6) for k in range(first, int(np.floor(high / interval)) + 1)][:most]


def simplified(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line Douglas and Peucker keep: of a span, the farthest from its chord, if that is beyond the tolerance, and so on in both halves. A ring is halved at the point farthest from its beginning."""
    keep = np.zeros(len(x), bool)
    if not len(x):
        return keep
    keep[[0, -1]] = True
    open_ = [(0, len(x) - 1)]
    if len(x) > 2 and x[0] == x[-1] and y[0] == y[-1]:
        far = 1 + int(np.argmax((x[1:-1] - x[0]) ** 2 + (y[1:-1] - y[0]) ** 2))
        keep[far] = True
        open_ = [(0, far), (far, len(x) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        long = np.hypot(dx, dy)
        apart = np.abs(px * dy - py * dx) / long if long > 0 else np.hypot(px, py)
        far = int(np.argmax(apart))
        if apart[far] > tolerance:
            far += a + 1
            keep[far] = True
            open_ += [(a, far), (far, b)]
    return keep


def simplify(points: DataFrame, tolerance: float, keys: Sequence[str], order: str = "place") -> DataFrame:
    """The points (x, y and more) of lines known by the keys that stay when each line is simplified. A task gets its lines one after the other, many in a batch, and holds one longer than a batch whole."""
    keys = list(keys)

    def kept(parts: list[pd.DataFrame]) -> pd.DataFrame:
        p = pd.concat(parts, ignore_index=True)
        edge = np.append(np.flatnonzero(starts(p)), len(p))
        x, y, keep = p.x.to_numpy(), p.y.to_numpy(), np.ones(len(p), bool)
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            if b - a > 2:
                keep[a:b] = simplified(x[a:b], y[a:b], tolerance)
        return p[keep]

    def starts(p: pd.DataFrame) -> np.ndarray:
        """Whether a row begins a line; the first one does."""
        return np.any([np.append(True, v[1:] != v[:-1]) for v in (p[k].to_numpy() for k in keys)], axis=0)

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = int(np.flatnonzero(starts(b))[-1])
            same = bool(held) and all(held[-1][k].iloc[-1] == b[k].iloc[0] for k in keys)
            if last or not same:
                if held or last:
                    yield kept([*held, b[:last]])
                held = []
            held.append(b[last:])
        if held:
            yield kept(held)

    return points.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, points.schema)


# --- Rings around patches.


def _exposed(cells: DataFrame, key: str) -> DataFrame:
    """Each cell with, for its eight neighbours in their order, whether they belong to the same patch."""
    every = F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"), F.lit(7 - k).alias("k"), F.col(key).alias("of"), F.lit(False).alias("own")) for k, (i, j) in enumerate(NEIGHBOURS)], F.struct("row", "col", F.lit(8).alias("k"), F.col(key).alias("of"), F.lit(True).alias("own")))
    x = cells.select(F.explode(every).alias("n")).groupBy("n.row", "n.col").agg(F.max(F.when(F.col("n.own"), F.col("n.of"))).alias(key), F.collect_list("n").alias("near"))
    same = F.transform(F.filter("near", lambda n: (n["of"] == F.col(key)) & ~n["own"]), lambda n: n["k"])
    return x.where(F.col(key).isNotNull()).select("row", "col", key, same.alias("near")).select("row", "col", key, *[F.array_contains("near", k).alias(f"n{k}") for k in range(8)])


#: Sides of a cell clockwise from the top: where each begins and ends (row, col), and the neighbours (in their order) beyond the side, ahead of its end, and diagonally ahead.
SIDES = (((0, 0), (0, 1), 1, 4, 2), ((0, 1), (1, 1), 4, 6, 7), ((1, 1), (1, 0), 6, 3, 5), ((1, 0), (0, 0), 3, 1, 0))


def ring_links(cells: DataFrame, key: str, width: int) -> DataFrame:
    """key, id and next of all sides of cells that border their patch, the patch on the right: four times the cell's number (row * width + col), and the side's.

    From a side's end the ring goes on along the same cell if its next side is exposed, else straight along the neighbour ahead, else along the
    diagonal neighbour, so that cells which touch at a corner alone are rings of their own.
    """
    number = lambda i, j: ((F.col("row") + i).cast("long") * width + F.col("col") + j) * 4
    links = []
    for s, ((y1, x1), (y2, x2), beyond, ahead, diagonal) in enumerate(SIDES):
        (ai, aj), (di, dj) = NEIGHBOURS[ahead], NEIGHBOURS[diagonal]
        to = F.when(~F.col(f"n{ahead}"), number(0, 0) + (s + 1) % 4).when(~F.col(f"n{diagonal}"), number(ai, aj) + s).otherwise(number(di, dj) + (s + 3) % 4)
        turns = F.when(~F.col(f"n{ahead}"), True).otherwise(F.col(f"n{diagonal}"))
        ends = [(F.col("col") + x1).alias("x"), (F.col("row") + y1).alias("y"), (F.col("col") + x2).alias("next_x"), (F.col("row") + y2).alias("next_y")]
        links.append(F.when(~F.col(f"n{beyond}"), F.struct((number(0, 0) + s).alias("id"), to.alias("next"), turns.alias("turns"), *ends)))
    return _exposed(cells, key).select(key, F.explode(F.array_compact(F.array(*links))).alias("s")).select(key, "s.*")


def ring_points(cells: DataFrame, key: str, width: int) -> DataFrame:
    """key, ring (its least side), place, x and y of the corners of every ring around and inside the patches, clockwise around them (y downwards) and the other way around holes; sides without a turn between them are one. x and y count from the grid's upper left corner."""
    links = cut(ring_links(cells, key, width))
    x = ranked_by_blocks(links.select("id", "next"), lambda c: F.floor(c / (4 * BLOCK))).select("id", F.col("chain").alias("ring"), "place").join(links, "id").where("turns")
    # A ring's corners keep their order; place counts them.
    return x.select(key, "ring", F.row_number().over(W.partitionBy("ring").orderBy("place")).alias("place"), F.col("next_x").alias("x"), F.col("next_y").alias("y"))


def ring_areas(points: DataFrame, *keys: str) -> DataFrame:
    """Corners and signed area of each ring, positive clockwise with y downwards: outer rings; negative: holes."""
    own = W.partitionBy(*keys).orderBy("place")
    every = W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(own), F.first(c).over(every))
    x = points.withColumn("cross", F.col("x") * after("y") - F.col("y") * after("x"))
    return x.groupBy(*keys).agg(F.count("*").alias("corners"), (F.sum("cross") / 2).alias("area"))


# --- Streams.


def stream_chains(edges: DataFrame, cells: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """id, chain and place of each stream cell: cells between two junctions are one chain, which begins at its source or junction. edges (id, to) among cells (id)."""
    inside = edges.join(cells.select("id"), "id", "left_semi").join(cells.select(F.col("id").alias("to")), "to", "left_semi")
    inside = cut(inside.select("id", "to"))
    single = inside.groupBy("to").agg(F.count("*").alias("n")).where("n = 1").select("to")
    order = ranked_by_blocks(inside.join(single, "to", "left_semi").select("id", F.col("to").alias("next")), lambda c: F.floor(c / BLOCK), rounds).select("id", "chain", "place")
    alone = cells.select("id").join(order, "id", "left_anti").select("id", F.col("id").alias("chain"), F.lit(0).cast("long").alias("place"))
    return cut(order.unionByName(alone))


def contracted(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """Edges (id, to) between chains: from each to the one that begins where it ends."""
    tails = edges.join(chains.select("id", "chain"), "id")
    heads = chains.where("place = 0").select(F.col("id").alias("to"))
    return tails.join(heads, "to", "left_semi").select(F.col("chain").alias("id"), "to")


def stream_orders(edges: DataFrame, cells: DataFrame, peel: Callable[[DataFrame, DataFrame], DataFrame], rounds: list[int] | None = None) -> DataFrame:
    """id, chain, place and order of each stream cell; peel finds orders on the contracted network, in as many rounds as junctions follow each other."""
    chains = stream_chains(edges, cells, rounds)
    heads = chains.where("place = 0").select("id")
    orders = peel(heads, cut(contracted(edges, chains))).select(F.col("id").alias("chain"), "order")
    return chains.join(orders, "chain")


def stream_points(edges: DataFrame, ordered: DataFrame, width: int) -> DataFrame:
    """line (its first cell), place, row, col and order of the points of stream lines, each from a source or junction to the next junction or the end, both included; lines of one cell are left out. ordered: id, chain, place, order."""
    ends = edges.join(ordered.select("id", "chain", "place", "order"), "id").join(ordered.where("place = 0").select(F.col("id").alias("to")), "to", "left_semi")
    x = ordered.select("chain", "place", "id", "order").unionByName(ends.select("chain", (F.col("place") + 1).alias("place"), F.col("to").alias("id"), "order"))
    x = cut(x)
    lines = x.where("place = 1").select("chain")
    return x.join(lines, "chain", "left_semi").select(F.col("chain").alias("line"), "place", F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"), "order")


def step_length(row: Column, col: Column, next_row: Column, next_col: Column, dx: float = 1.0, dy: float = 1.0) -> Column:
    """Length of a step to one of the eight neighbours."""
    return F.hypot((next_row - row) * dy, (next_col - col) * dx)


def stream_lengths(edges: DataFrame, ordered: DataFrame, width: int, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """order, cells and length of the streams: each cell's step to the next one counts for its own order."""
    at = lambda c: (F.floor(F.col(c) / width), F.col(c) % width)
    x = ordered.select("id", "order").join(edges, "id", "left")
    step = F.when(F.col("to").isNotNull(), step_length(*at("id"), *at("to"), dx, dy)).otherwise(0.0)
    return x.groupBy("order").agg(F.count("*").alias("cells"), F.sum(step).alias("length"))


def terminals(edges: DataFrame, ids: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """id and end: where each id's path ends, by doubling; rounds are the logarithm of the longest path."""
    x = cut(ids.select("id").join(edges.select("id", F.col("to").alias("end")), "id", "left").select("id", F.coalesce("end", "id").alias("end")))
    while True:
        y = x.join(x.select(F.col("id").alias("end"), F.col("end").alias("over")), "end").select("id", F.col("over").alias("end"), (F.col("over") != F.col("end")).alias("moved"))
        y = cut(y)
        moved = y.where("moved").count()
        if rounds is not None:
            rounds.append(moved)
        x = y.drop("moved")
        if not moved:
            return x


def watershed(edges: DataFrame, ids: DataFrame, outlet: int, rounds: list[int] | None = None) -> DataFrame:
    """Ids from which the flow reaches the outlet, the outlet included."""
    return terminals(edges.where(F.col("id") != outlet), ids, rounds).where(F.col("end") == outlet).select("id")


def geojson_lines(points: DataFrame, keys: Iterable[str], lon: Column, lat: Column) -> DataFrame:
    """The keys and a LineString of each line as GeoJSON text, coordinates to 7 places. points: the keys, place and what lon and lat need. A line is one row."""
    keys = list(keys)
    p = points.select(*keys, "place", F.array(F.round(lon, 7), F.round(lat, 7)).alias("p")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("ps"))
    return p.where(F.size("ps") >= 2).select(*keys, F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("ps", lambda s: s["p"]).alias("coordinates"))).alias("geometry"))
