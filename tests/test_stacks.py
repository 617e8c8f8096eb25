"""Edges of the operators on stacks, canopies, samples, photos and checks, and of quantiles in two passes."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import metrics
from fieldloom.operators import assessment, canopy, cells, checks, photos, stacks, stats


def test_quantiles_are_exact_for_any_shape(spark):
    r = random.Random(5)
    shapes = {"flat": [r.random() for _ in range(997)], "one": [7.0], "two": [1.0, 5.0], "ties": [3.0] * 400 + [r.gauss(0, 1) for _ in range(211)], "far": [1e300, -1e300] + [r.random() for _ in range(300)]}
    rows = [(k, v) for k, x in shapes.items() for v in x] + [("none", None), ("none", float("nan")), (None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]
    for accuracy in (20, 10_000):
        got = {x["k"]: x["q"] for x in stats.quantiles(df, "v", shares, "k", accuracy=accuracy).collect()}
        assert set(got) == {*shapes, None}
        for k, x in {**shapes, None: [4.0, 6.0]}.items():
            assert np.allclose(got[k], np.quantile(x, shares), rtol=1e-12, atol=1e-12), (k, accuracy)


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    (row,) = stats.summary(df, "v", "k").collect()
    assert (row.n, row.mean, row.sd, row.median) == (0, None, None, None)
    (row,) = stats.summary(df.where("false"), "v").collect()
    assert (row.n, row.q1) == (0, None)


def test_positions_follow_the_order(spark):
    x = stats.positions(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")), ["v"])
    assert x.where("position <> v or rows <> 1000").count() == 0 and x.count() == 1000


def test_neighbours_across_a_gap_are_missing(spark):
    g = spark.createDataFrame([(r, c, 1.0) for r in range(5) for c in range(5) if (r, c) != (2, 2)], "row int, col int, z double")
    x = {(n.row, n.col): n for n in cells.neighbourhood(g, "z").collect()}
    assert x[2, 1].f is None and x[2, 3].d is None and x[1, 2].h is None and x[3, 2].b is None
    assert x[2, 1].d == 1.0


def test_smoothing_keeps_a_constant_and_missing_cells(spark):
    rows = [(r, c, None if (r, c) == (4, 4) else 2.0) for r in range(8) for c in range(8)]
    x = {(n.row, n.col): n.smooth for n in cells.gaussian(spark.createDataFrame(rows, "row int, col int, z double"), "z").collect()}
    assert len(x) == 64 and x[4, 4] is None and math.isclose(x[0, 0], 2.0) and x[4, 3] < 2.0


def test_sparse_images_and_small_patches(spark):
    cells_ = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("c", 4.0), *[("c", None)] * 9], "date string, v double")
    x = {r.date: (r.mean, r.median, r.sparse) for r in stacks.image_rows(cells_, "date", "v").collect()}
    assert x == {"a": (2.0, 2.0, False), "b": (None, None, True), "c": (4.0, 4.0, True)}
    g = spark.createDataFrame([(0, 0, 2), (0, 1, 2), (0, 5, 2), (0, 7, 3)], "row int, col int, class int")
    p = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 5, 5)], "row int, col int, patch int")
    got = {r.col: r["class"] for r in stacks.without_small_patches(g, p, F.lit(1.0), 2.0, "class", 1).collect()}
    assert got == {0: 2, 1: 2, 5: 1, 7: 3}
    assert stacks.removal_report(p.where("false"), F.lit(1.0), 2.0).first().asDict() == {"removed_patches": 0, "removed_cells": 0, "removed_area": 0.0, "kept": 0, "largest": 0.0}


def test_canopy_points_on_edges_and_no_canopy(spark):
    pts = spark.createDataFrame([(0.0, 2.0, 5.0), (2.0, 0.0, 7.0), (2.1, 0.0, 9.0)], "x double, y double, z double")
    got = {(r.row, r.col): r.highest for r in canopy.gridded_extremes(pts, 0.0, 2.0, 1.0, 2, 2, F.lit(True), F.lit(True)).collect()}
    assert got == {(0, 0): 5.0, (1, 1): 7.0}
    (row,) = canopy.canopy_statistics(spark.createDataFrame([(1.0,), (None,)], "h double"), "h", F.lit(1.0)).collect()
    assert (row.area, row.cover, row.median, row["max"]) == (1.0, 0.0, None, None)


def test_accuracies_of_an_unsampled_class(spark):
    m = spark.createDataFrame([("a", "a", 9), ("a", "b", 1)], "mapped string, reference string, n int")
    a = spark.createDataFrame([("a", 60.0), ("b", 40.0)], "mapped string, area double")
    x = {r["class"]: r for r in assessment.accuracies(m, a).collect()}
    assert math.isclose(x["a"].user, 0.9) and x["b"].user is None and x["b"].samples == 0
    assert math.isclose(x["b"].area, 6.0) and math.isclose(x["a"].area_half, 1.959964 * 100 * math.sqrt(0.36 * 0.09 / 9))
    n = spark.createDataFrame([(0.25,), (0.75,)], "w double").agg(assessment.cochran(F.col("w")).alias("n")).first().n
    assert n == 1600


def test_ratio_total_cuts_at_zero(spark):
    r = spark.createDataFrame([(2, 1.5, 4.0), (1, 1.0, None)], "n long, r double, variance double")
    x = {row.n: row for row in assessment.ratio_total(r, 10.0).collect()}
    assert x[2].low == 0.0 and math.isclose(x[2].high, 15 + 12.706204736 * 20, rel_tol=1e-6) and x[1].high is None


def test_photos_and_metrics(spark):
    x = spark.createDataFrame([(10, 200, 10, 255), (0, 0, 0, 255), (9, 9, 9, 127)], "red int, green int, blue int, alpha int")
    (row,) = photos.channel_statistics(x, 0.1).collect()
    assert (row.pixels, row.vegetation) == (2, 0.5)
    names = spark.createDataFrame([(n,) for n in ("NDVI_mean", "landSurfaceTemp", "temperature", "rain", "depth", None)], "n string")
    assert [r[0] for r in names.select(metrics.metric(F.col("n"))).collect()] == ["ndvi", "lst", "airTemp", "precip", "generic", "generic"]


def test_order_and_retention(spark):
    x = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 4), ("b", 1, 1), ("b", 2, 1)], "k string, i int, t int")
    assert {r.k: r.unordered for r in checks.out_of_order(x, "t", "i", "k").collect()} == {"a": True, "b": False}
    y = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "o int, p int")
    assert [r.o for r in checks.orders_within(y, "o", "p", 50).collect()] == [3, 2]
