"""Terrain as whole jobs over the grid: contours, rings of patches, streams, filled levels and flow by facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import chains, networks, tiles
from fieldloom.plans.networks import DIRECTED, HIGH, WIDTH, _edges, _high, _ids
from fieldloom.plans.registry import query
from fieldloom.session import cut
from fieldloom.sources import standins

LEVELS = (0.18, 0.25, 0.32)
#: Cells that flow through a cell from which it is a stream.
STREAM = 6.0

#: Crossings of levels with the lines between cell centres, and which follows which with the high side on the right.
CROSSED = f"""WITH RECURSIVE {standins.GRID}, q AS (SELECT a.row, a.col, level, a.z AS v0, b.z AS v1, c.z AS v2, d.z AS v3, CAST(a.row AS BIGINT) * 64 + a.col AS n FROM grid a JOIN grid b ON b.row = a.row AND b.col = a.col + 1 JOIN grid c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN grid d ON d.row = a.row + 1 AND d.col = a.col, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in LEVELS)}]) AS level)),
h AS (SELECT *, v0 >= level AS h0, v1 >= level AS h1, v2 >= level AS h2, v3 >= level AS h3 FROM q),
sides AS (SELECT row, col, level, k, CASE k WHEN 0 THEN 2 * n WHEN 1 THEN 2 * (n + 1) + 1 WHEN 2 THEN 2 * (n + 64) ELSE 2 * n + 1 END AS key,
 CASE k WHEN 0 THEN col + 0.5 + (level - v0) / (v1 - v0) WHEN 1 THEN col + 1.5 WHEN 2 THEN col + 0.5 + (level - v3) / (v2 - v3) ELSE col + 0.5 END AS x,
 CASE k WHEN 0 THEN row + 0.5 WHEN 1 THEN row + 0.5 + (level - v1) / (v2 - v1) WHEN 2 THEN row + 1.5 ELSE row + 0.5 + (level - v0) / (v3 - v0) END AS y,
 CASE k WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END AS falls, h0 = h2 AND h1 = h3 AS saddle, (v0 + v1 + v2 + v3) / 4 >= level AS joined
 FROM h, (SELECT unnest(range(4)) AS k) WHERE CASE k WHEN 0 THEN h0 <> h1 WHEN 1 THEN h1 <> h2 WHEN 2 THEN h2 <> h3 ELSE h3 <> h0 END),
links AS MATERIALIZED (SELECT a.level, a.key AS id, a.x, a.y, b.key AS next, b.x AS next_x, b.y AS next_y FROM sides a JOIN sides b ON a.row = b.row AND a.col = b.col AND a.level = b.level AND a.falls AND NOT b.falls AND (NOT a.saddle OR b.k = (a.k + CASE WHEN a.joined THEN 1 ELSE 3 END) % 4))"""

#: Places in chains of links (keys g, id, next): open ones from their first element, rings from their least.
WALKED = """heads AS (SELECT l.g, l.id FROM links l ANTI JOIN links b ON b.g = l.g AND b.next = l.id),
walk AS (SELECT g, id AS chain, id, CAST(0 AS BIGINT) AS place FROM heads UNION ALL SELECT w.g, w.chain, l.next, w.place + 1 FROM walk w JOIN links l ON l.g = w.g AND l.id = w.id),
round AS (SELECT g, id AS chain, id, CAST(0 AS BIGINT) AS place FROM (SELECT g, id FROM links ANTI JOIN walk USING (g, id)) UNION ALL SELECT r.g, r.chain, l.next, r.place + 1 FROM round r JOIN links l ON l.g = r.g AND l.id = r.id WHERE l.next <> r.chain),
least AS (SELECT g, chain FROM round GROUP BY g, chain HAVING min(id) = chain),
placed AS (SELECT g, chain, id, place, false AS ring FROM walk UNION ALL SELECT g, chain, id, place, true FROM round SEMI JOIN least USING (g, chain))"""


@query(CROSSED.replace("SELECT a.level, a.key AS id", "SELECT a.level AS g, a.key AS id") + f""", {WALKED},
points AS (SELECT g, id, min(x) AS x, min(y) AS y FROM (SELECT g, id, x, y FROM links UNION ALL SELECT g, next, next_x, next_y FROM links) GROUP BY g, id),
lines AS (SELECT g, chain, ring, min(id) AS line, count(*) AS n FROM placed GROUP BY ALL),
every AS (SELECT p.g, line, place, id, ring FROM placed p JOIN lines USING (g, chain, ring) UNION ALL SELECT p.g, line, n, id, ring FROM placed p JOIN lines USING (g, chain, ring) WHERE ring AND place = 0)
SELECT g AS level, line, place, round(x, 9) AS x, round(y, 9) AS y, ring FROM every JOIN points USING (g, id)""")
def contour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the contour lines of three levels, in order."""
    x = chains.contour_points(standins.grid(spark, sf_dir), "z", LEVELS, WIDTH)
    return x.select("level", "line", "place", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "ring")


@query()
def contours_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that stay when contour lines are simplified to a quarter of a cell; a recursion over spans, which tests hold against a plain one."""
    return chains.simplify(chains.contour_points(standins.grid(spark, sf_dir), "z", LEVELS, WIDTH), 0.25, ["level", "line"])


#: Sides of high cells that border their patch, and which follows which, with the patch on the right.
BORDERED = HIGH + """, lab AS (SELECT x.row, x.col, x.id AS cell, patch FROM label JOIN x ON x.id = label.id),
near AS (SELECT a.row, a.col, a.cell, a.patch, (SELECT unnest(range(1)) * 0) AS zero, {flags} FROM lab a {joins}),
turned AS (SELECT *, unnest([{sides}]) AS s FROM near),
links AS MATERIALIZED (SELECT patch AS g, s.id AS id, s.next AS next, s.turns AS turns, s.x AS x, s.y AS y FROM turned WHERE s.id IS NOT NULL)"""


def _bordered() -> str:
    flags = ", ".join(f"b{k}.cell IS NOT NULL AS n{k}" for k in range(8))
    joins = " ".join(f"LEFT JOIN lab b{k} ON b{k}.row = a.row + {i} AND b{k}.col = a.col + {j} AND b{k}.patch = a.patch" for k, (i, j) in enumerate(networks.NEIGHBOURS))
    sides = []
    for s, (_, (y2, x2), beyond, ahead, diagonal) in enumerate(chains.SIDES):
        (ai, aj), (di, dj) = networks.NEIGHBOURS[ahead], networks.NEIGHBOURS[diagonal]
        to = f"CASE WHEN NOT n{ahead} THEN cell * 4 + {(s + 1) % 4} WHEN NOT n{diagonal} THEN (cell + {ai * 64 + aj}) * 4 + {s} ELSE (cell + {di * 64 + dj}) * 4 + {(s + 3) % 4} END"
        sides.append(f"CASE WHEN NOT n{beyond} THEN {{'id': cell * 4 + {s}, 'next': {to}, 'turns': NOT n{ahead} OR n{diagonal}, 'x': col + {x2}, 'y': row + {y2}}} END")
    return BORDERED.replace("{flags}", flags).replace("{joins}", joins).replace("{sides}", ", ".join(sides)).replace("(SELECT unnest(range(1)) * 0) AS zero, ", "")


@query(_bordered() + f""", {WALKED},
corners AS (SELECT g, chain, row_number() OVER (PARTITION BY g, chain ORDER BY place) AS place, x, y FROM placed JOIN links USING (g, id) WHERE turns),
crossed AS (SELECT g, chain, x * coalesce(lead(y) OVER w, first_value(y) OVER w) - y * coalesce(lead(x) OVER w, first_value(x) OVER w) AS turn FROM corners WINDOW w AS (PARTITION BY g, chain ORDER BY place))
SELECT g AS patch, chain AS ring, count(*) AS corners, CAST(sum("turn") AS DOUBLE) / 2 AS area FROM crossed GROUP BY ALL""")
def patch_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings around and inside the patches of high cells, with their corners and signed areas (negative: holes)."""
    return chains.ring_areas(chains.ring_points(_high(spark, sf_dir), "patch", WIDTH), "patch", "ring")


def _higher(k: int) -> str:
    """Cells of order k + 1 or more: all below a cell at which two of order k or more meet."""
    return f"""j{k} AS (SELECT e.to_ AS id FROM edges e JOIN s{k} ON s{k}.id = e.id GROUP BY e.to_ HAVING count(*) >= 2), s{k + 1} AS (SELECT id FROM j{k} UNION SELECT e.to_ FROM s{k + 1} r JOIN edges e ON e.id = r.id)"""


ORDERS = "s1 AS (SELECT id FROM cells), " + ", ".join(_higher(k) for k in range(1, 8)) + ", orders AS (SELECT id, CAST(count(*) AS INT) AS \"order\" FROM (" + " UNION ALL ".join(f"SELECT id FROM s{k}" for k in range(1, 9)) + ") GROUP BY id)"


@query(DIRECTED + f', cells AS (SELECT CAST(row AS BIGINT) * 64 + col AS id FROM grid), {ORDERS} SELECT id, "order" FROM orders')
def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strahler's order of every cell of the flow graph: one more at each meeting of two cells of the highest order that flows in."""
    return chains.stream_orders(cut(_edges(spark, sf_dir)), _ids(spark, sf_dir), networks.strahler).select("id", "order")


STREAMS = (
    DIRECTED.replace("edges AS MATERIALIZED", "all_edges AS MATERIALIZED")
    + """, path AS (SELECT CAST(row AS BIGINT) * 64 + col AS start, CAST(row AS BIGINT) * 64 + col AS id FROM grid UNION ALL SELECT p.start, e.to_ FROM path p JOIN all_edges e ON e.id = p.id),
cells AS MATERIALIZED (SELECT id FROM path GROUP BY id HAVING count(*) >= """
    + str(int(STREAM))
    + f"""), edges AS MATERIALIZED (SELECT id, to_ FROM all_edges SEMI JOIN cells USING (id)), {ORDERS}"""
)


def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges and ordered cells of the streams."""
    edges = cut(_edges(spark, sf_dir))
    through = networks.flow_accumulation(_ids(spark, sf_dir).withColumn("one", F.lit(1.0)), edges, "one")
    cells = through.where(F.col("total") >= STREAM).select("id")
    return edges, cut(chains.stream_orders(edges, cells, networks.strahler))


@query(STREAMS + """, t AS (SELECT "order", CASE WHEN to_ IS NULL THEN 0.0 ELSE sqrt((id // 64 - to_ // 64) ** 2 + (id % 64 - to_ % 64) ** 2) END AS step FROM orders LEFT JOIN edges USING (id)) SELECT "order", count(*) AS cells, round(sum(step), 6) AS length FROM t GROUP BY "order\"""")
def stream_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and length of the streams of each order, from the cells that six or more flow through."""
    return chains.stream_lengths(*_streams(spark, sf_dir), WIDTH).select("order", "cells", F.round("length", 6).alias("length"))


@query(STREAMS + """, joins AS (SELECT id FROM cells ANTI JOIN (SELECT to_ AS id FROM edges GROUP BY to_ HAVING count(*) = 1) USING (id)),
walk AS (SELECT id AS line, id, CAST(0 AS BIGINT) AS place FROM joins UNION ALL SELECT w.line, e.to_, w.place + 1 FROM walk w JOIN edges e ON e.id = w.id WHERE w.place = 0 OR w.id NOT IN (SELECT id FROM joins))
SELECT line, place, CAST(w.id // 64 AS INT) AS row, CAST(w.id % 64 AS INT) AS col, "order" FROM walk w JOIN orders o ON o.id = line WHERE line IN (SELECT line FROM walk WHERE place = 1)""")
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the stream lines between sources, junctions and ends."""
    return chains.stream_points(*_streams(spark, sf_dir), WIDTH)


@query()
def depression_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the whole grid after filling; tests hold tiles of several sizes against a plain flood."""
    x = tiles.filled(standins.grid(spark, sf_dir), "z")
    return x.select("row", "col", F.round("z", 6).alias("z"), F.round("level", 6).alias("level"))


@query()
def facet_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upslope area, catchment a width and wetness on the filled grid, with flow split between two neighbours; tests hold it against brute force, planes and a cone."""
    x = tiles.two_way_flow(tiles.filled(standins.grid(spark, sf_dir), "z"), "level")
    return x.select("row", "col", *[F.round(c, 6).alias(c) for c in ("upslope", "catchment", "wetness")])


@query()
def upslope_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each cell's flow that reaches one outlet of the filled grid."""
    return tiles.upslope_share(tiles.filled(standins.grid(spark, sf_dir), "z"), "level", (100, 1)).select("row", "col", F.round("share", 9).alias("share"))
