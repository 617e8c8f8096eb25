"""Fits, tree tops and distances against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import canopy, fits, regrid, tiles


def column(spark, v, name="v"):
    return spark.createDataFrame(pd.DataFrame({name: v}))


def test_gate_of_thresholds(spark):
    rng = np.random.default_rng(1)
    two = np.concatenate([rng.normal(-0.4, 0.05, 3000), rng.normal(0.3, 0.08, 2000), [np.nan, np.inf]])
    assert fits.apart(column(spark, two), "v") == pytest.approx(math.sqrt(2) * 0.7 / math.hypot(0.05, 0.08), rel=0.05)
    found, why = fits.gated_threshold(column(spark, two), "v", (-0.3, 0.3), 0.0)
    assert why == "parted" and -0.25 < found < 0.1
    assert fits.gated_threshold(column(spark, two), "v", (0.5, 0.9), 0.1) == (0.1, "outside")
    assert fits.gated_threshold(column(spark, rng.normal(0, 1, 3000)), "v", (-3, 3), 0.1) == (0.1, "mixed")
    assert fits.gated_threshold(column(spark, two[:99]), "v", (-3, 3), 0.1) == (0.1, "few")
    assert fits.gated_threshold(column(spark, np.full(500, 2.0)), "v", (-3, 3), 0.1) == (0.1, "mixed")


def test_mixture_of_a_histogram():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, 60_000), rng.normal(5, 2, 40_000)])
    n, edges = np.histogram(v, 2000)
    share, mean, deviation = fits.two_normals((edges[:-1] + edges[1:]) / 2, n.astype(float))
    assert np.allclose(share, [0.6, 0.4], atol=0.02) and np.allclose(mean, [0, 5], atol=0.1) and np.allclose(deviation, [1, 2], atol=0.1)


def test_changed_places_do_not_pull_the_line(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 1, 4000)
    b = 1.3 * a + 0.2 + rng.normal(0, 0.02, 4000)
    b[:300] += 0.9
    x = spark.createDataFrame(pd.DataFrame({"i": range(4002), "a": [*a, np.nan, 0.5], "b": [*b, 0.4, np.inf]}))
    f = fits.alike(x, "a", "b")
    assert f["gain"] == pytest.approx(1.3, abs=0.02) and f["offset"] == pytest.approx(0.2, abs=0.02) and f["spread"] == pytest.approx(0.022, abs=0.004)

    def plain():
        use = np.ones(4000, bool)
        for _ in range(4):
            gain, offset = np.polyfit(a[use], b[use], 1)
            r = b - gain * a - offset
            mid = np.median(r)
            spread = max(1e-6, 1.4826 * np.median(np.abs(r - mid)))
            use = np.abs(r - mid) < 2.5 * spread
        return gain, offset, max(spread, 0.01 * np.ptp(b))

    assert [f[k] for k in ("gain", "offset", "spread")] == pytest.approx(plain(), rel=1e-9)
    y, threshold = fits.change_magnitude(x, [("a", "b")])
    got = {r.i: r for r in y.collect()}
    assert threshold >= 2.5 and all(got[i].changed for i in range(300)) and sum(r.changed for r in got.values()) < 330
    assert [(got[i].magnitude, got[i].changed) for i in (4000, 4001)] == [(0.0, False)] * 2
    none = fits.change_magnitude(x.where("i >= 4000"), [("a", "b")])
    assert none[1] == 2.5 and [r.changed for r in none[0].collect()] == [False, False]


def test_biomass_by_height(spark):
    rng = np.random.default_rng(4)
    h = rng.uniform(5, 30, 25)
    m = 2.1 * h**1.4 * np.exp(rng.normal(0, 0.2, 25))
    plots = spark.createDataFrame(pd.DataFrame({"h": [*h, 0.0, np.nan], "m": [*m, 5.0, 1.0]}))
    f = fits.height_model(plots, "h", "m")
    x = np.column_stack([np.ones(25), np.log(h)])
    beta = np.linalg.lstsq(x, np.log(m), rcond=None)[0]
    s2 = float(((np.log(m) - x @ beta) ** 2).sum()) / 23
    assert (f["plots"], f["b"], f["a"], f["spread"]) == (25, pytest.approx(beta[1]), pytest.approx(math.exp(s2 / 2 + beta[0])), pytest.approx(math.sqrt(s2)))
    left = []
    for i in range(25):
        k = np.arange(25) != i
        own = np.linalg.lstsq(x[k], np.log(m[k]), rcond=None)[0]
        left.append(math.exp(float(((np.log(m[k]) - x[k] @ own) ** 2).sum()) / 22 / 2 + float(x[i] @ own)) - m[i])
    assert f["loo_rmse"] == pytest.approx(math.sqrt(np.mean(np.square(left))), rel=1e-9)
    cells = np.concatenate([rng.uniform(2, 28, 400), [0.2, np.nan]])
    got = fits.total_biomass(f, spark.createDataFrame(pd.DataFrame({"h": cells, "ha": 0.25})), "h", "ha", draws=4000)
    own = cells[:400]
    assert got["hectares"] == pytest.approx(401 * 0.25) and got["total"] == pytest.approx((f["a"] * own ** f["b"]).sum() * 0.25)
    assert got["beyond"] == pytest.approx(((own < h.min()) | (own > h.max())).sum() / 401)
    cov = s2 * np.linalg.inv(x.T @ x)
    drawn = [float(np.exp((beta + np.linalg.cholesky(cov) @ (rng.standard_normal(2) * math.sqrt(23 / rng.chisquare(23)))) @ np.vstack([np.ones(400), np.log(own)]) + rng.normal(0, math.sqrt(s2), 400)).sum()) * 0.25 for _ in range(4000)]
    low, high = np.percentile(drawn, [2.5, 97.5])
    assert got["low"] == pytest.approx(low, rel=0.03) and got["high"] == pytest.approx(high, rel=0.03) and got["low"] < got["total"] < got["high"]
    with pytest.raises(ValueError, match="five plots"):
        fits.height_model(plots.limit(4), "h", "m")


@pytest.mark.parametrize("seed", [5, 6])
def test_tree_tops(spark, seed):
    rng = np.random.default_rng(seed)
    z = np.round(rng.uniform(0, 30, (60, 60)), 0 if seed == 5 else 3)
    z[rng.random(z.shape) < 0.1] = np.nan
    r, c = np.nonzero(~np.isnan(z))
    got = canopy.tree_tops(spark.createDataFrame(pd.DataFrame({"row": r, "col": c, "h": z[r, c]}), "row int, col int, h double"), "h", 4.0, 0.5).collect()
    want = set()
    for i, j in zip(r, c, strict=True):
        v = z[i, j]
        radius = max(1, int((3.75105 - 0.17919 * v + 0.01241 * v * v) / 2 / 0.5 + 0.5))
        beats = lambda a, b: 0 <= a < 60 and 0 <= b < 60 and (a, b) != (i, j) and (a - i) ** 2 + (b - j) ** 2 <= radius**2 and (z[a, b] > v or (z[a, b] == v and (a, b) < (i, j)))  # noqa: B023, E731
        if v >= 4 and not any(beats(a, b) for a in range(i - radius, i + radius + 1) for b in range(j - radius, j + radius + 1)):
            want.add((i, j, v, radius))
    assert {(x.row, x.col, x.h, x.radius) for x in got} == want and len(got) == len(want) > 5


@pytest.mark.parametrize("size", [8, 64])
def test_depth_is_the_chamfer_distance(spark, size):
    rng = np.random.default_rng(7)
    inside = rng.random((60, 60)) < 0.97
    df = spark.createDataFrame(pd.DataFrame({"row": np.repeat(range(60), 60), "col": np.tile(range(60), 60), "inside": inside.ravel()}), "row int, col int, inside boolean")
    rounds = []
    got = tiles.depth(df, "inside", size, rounds).toPandas().set_index(["row", "col"])
    out = np.argwhere(~inside)
    for i in range(60):
        d = np.abs(out[None] - np.column_stack([np.full(60, i), np.arange(60)])[:, None])
        want = ((4 * d.min(axis=2) + 3 * (d.max(axis=2) - d.min(axis=2))) / 3).min(axis=1)
        assert np.allclose(got.loc[i].sort_index().depth, want) and (got.loc[i].sort_index().inside == inside[i]).all()
    assert tiles.depth(df.where("inside"), "inside", size).where("depth is not null").count() == 0 and rounds[-1] == 0
    assert df.where(F.col("inside")).count() > 3000


def test_a_worker_holds_one_tile_at_a_time(spark):
    """700 tiles of one cell each, half a megabyte a tile: what a worker holds doesn't grow with the tiles of its partition."""

    def held(z, around):
        x = around.copy()
        with open("/proc/self/statm") as f:
            x[1:-1, 1:-1] = np.where(np.isnan(z[1:-1, 1:-1]), np.inf, int(f.read().split()[1]) * 4096 / 1e6)
        return x

    df = spark.range(700).selectExpr("int(id * 256 + 128) AS row", "128 AS col", "1.0D AS v")
    got = tiles.spread(df, "v", held).toPandas()
    assert len(got) == 700 and got.level.max() - got.level.min() < 20


@pytest.mark.parametrize("share", [0.5, 0.02, 0.0])
def test_holes_take_the_nearest_value(spark, share):
    rng = np.random.default_rng(8)
    z = np.where(rng.random((45, 37)) < share, np.round(rng.random((45, 37)), 6), np.nan)
    keep = rng.random(z.shape) < 0.9
    r, c = np.nonzero(keep)
    got = regrid.nearest_filled(spark.createDataFrame(pd.DataFrame({"row": r, "col": c, "z": z[r, c]}), "row int, col int, z double"), "z").collect()
    known = [(int(a), int(b)) for a, b in zip(r, c, strict=True) if not np.isnan(z[a, b])]
    assert len(got) == len(r)
    for x in got:
        want = min(known, key=lambda k: ((k[0] - x.row) ** 2 + (k[1] - x.col) ** 2, k), default=None)
        assert (x.source_row, x.source_col) == (want or (None, None)) and x.z == (z[want] if want else None)


def test_images_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(k):
        seen.add(1)
        return float(k * 7919 % 101)

    x = spark.range(200).select("id", F.udf(told, "double")("id").alias("a")).withColumn("b", F.col("a") * 2 + F.col("id") % 3)
    fits.change_magnitude(x, [("a", "b")])[0].count()
    assert seen.value == 200
