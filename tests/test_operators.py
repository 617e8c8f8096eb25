"""Closed forms and golden values of operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import classes, dates, dist, text
from fieldloom.operators import carbon, cells, chains, climate, networks, series, stats, vector


def test_trend_of_ten_rising_points(spark):
    x = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "t double, v double")
    r = stats.trend(x, "t", "v").first()
    assert (r.n, r.s, r.direction) == (10, 45, "rising")
    assert math.isclose(r.z, 44 / math.sqrt(125))


def test_summary_quartiles_and_missing(spark):
    x = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (float("nan"),), (None,)], "v double")
    r = stats.summary(x, "v").first()
    assert (r.n, r.q1, r.median, r.q3) == (4, 1.75, 2.5, 3.25)
    assert stats.summary(x.where("v = 1"), "v").first().sd == 0


def test_histogram_of_constant_data(spark):
    assert [tuple(r) for r in stats.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v").collect()] == [(0, 5.0, 2)]


def test_dates(spark):
    cases = [("2020-02-29", "2020-02-29"), ("2015-02-29", None), ("2020/3/1 10:00", "2020-03-01"), ("13/02/2020", "2020-02-13"), ("2020-060", "2020-02-29"), ("2020.366", "2020-12-31"), ("2019-366", None), ("2020-5", "2020-05-01"), ("1999", "1999-01-01"), ("0999", None), ("2024075", "2024-03-15"), ("2024/03", "2024-03-01"), ("2024.03", "2024-03-01"), ("2024/075", None), ("2020-05 10:00", None), ("x", None), (None, None)]
    x = spark.createDataFrame(cases, "cell string, want string")
    for r in x.select("cell", "want", dates.parse_date(F.col("cell")).cast("string").alias("got")).collect():
        assert r.got == r.want, r
    order = dates.month_first(spark.createDataFrame([("02/13/2020",), ("01/02/2020",)], "c string"), "c").first()
    assert tuple(order) == (True, False)
    names = spark.createDataFrame([("S2_20200229_x.tif", "2020-02-29"), ("a-2020-03-01.tif", "2020-03-01"), ("L2020060.tif", "2020-02-29"), ("none.tif", None), ("x20240315.20250101", "2024-03-15"), ("a1234-2024_075b.tif", "2024-03-15"), ("2024.0315.tif", "2024-03-15"), ("202403-15_x.tif", "2024-03-15"), ("120240315.tif", None), ("2024-13-40_2023-366.tif", "2024-01-01"), ("2024--03--15.tif", None), (None, None)], "n string, want string")
    for r in names.select("want", dates.date_from_name(F.col("n")).cast("string").alias("got")).collect():
        assert r.got == r.want


def test_class_edges(spark):
    x = spark.createDataFrame([(-0.3,), (-0.25,), (0.44,), (0.66,), (None,)], "v double")
    assert [r[0] for r in x.select(classes.ladder(F.col("v"), classes.BURN_SEVERITY)).collect()] == [0, 1, 5, 6, None]
    s = spark.createDataFrame([(2.0,), (-2.0,), (1.0,), (-1.0,), (0.0,)], "v double")
    assert [r[0] for r in s.select(classes.spi_class(F.col("v"))).collect()] == [3, -3, 1, -1, 0]


def test_distributions():
    assert np.allclose(dist.normal_inverse(np.array([0.025, 0.5, 0.975])), [-1.959963984540054, 0, 1.959963984540054], atol=1e-9)
    assert np.allclose(dist.gamma_cdf(np.array([1.0, 1.0, 5.0]), np.array([0.5, 3.0, 2.0])), [1 - math.exp(-0.5), 1 - math.exp(-3), 0.052653017], atol=1e-8)
    assert math.isclose(dist.t_quantile(0.975, 4), 2.7764451, abs_tol=1e-6) and math.isclose(dist.t_quantile(0.975, 9), 2.2621572, abs_tol=1e-6)


def test_rain_indices(spark):
    v = [0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 0.0, 12.4]
    x = spark.createDataFrame([(i, w) for i, w in enumerate(v)], "i int, v double").select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("d"), "v")
    r = climate.rain_indices(x, "d", "v").first()
    assert (round(r.total, 6), r.rainy_days, r.dry_spell, r.missing_days, str(r.wettest_day)) == (17.4, 2, 4, 0, "2020-01-08")


def test_precipitation_index_is_standard_normal(spark):
    rng = np.random.default_rng(1)
    rows = [(y * 12 + m, m + 1, float(rng.gamma(2.0, 30.0))) for y in range(60) for m in range(12)]
    x = climate.spi(spark.createDataFrame(rows, "t int, m int, v double"), "v", 1).toPandas()
    assert abs(x.spi.mean()) < 0.05 and abs(x.spi.std() - 1) < 0.05


def test_planes_have_their_slope(spark):
    g = spark.createDataFrame([(r, c, 0.5 * c) for r in range(5) for c in range(6)], "row int, col int, z double")
    x = cells.horn(cells.neighbourhood(g, "z")).where("slope is not null").toPandas()
    assert len(x) == 12 and np.allclose(x.slope, math.degrees(math.atan(0.5))) and np.allclose(x.aspect, 270)


def test_patches_and_flow(spark):
    on = {(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (9, 0)}
    p = networks.patches(spark.createDataFrame(list(on), "row int, col int"), 10).toPandas()
    assert sorted(p.groupby("patch").size().tolist()) == [1, 2, 3]
    g = spark.createDataFrame([(0, c, float(9 - c)) for c in range(10)], "row int, col int, z double")
    d = networks.flow_direction(g, "z")
    e = networks.downstream(d, 10)
    acc = {r.id: r.total for r in networks.flow_accumulation(g.select(F.col("col").cast("long").alias("id"), F.lit(1.0).alias("w")), e, "w").collect()}
    assert acc == {i: float(i + 1) for i in range(10)}
    assert chains.watershed(e, spark.range(10), 4).count() == 5


def test_stream_order_of_a_confluence(spark):
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 5)], "id long, to long")
    assert {r.id: r.order for r in networks.strahler(spark.range(1, 6), e).collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 2}


def test_single_break(spark):
    rng = np.random.default_rng(2)
    y = np.concatenate([0.8 + rng.normal(0, 0.01, 20), 0.4 + rng.normal(0, 0.01, 15)])
    x = spark.createDataFrame([("a", float(t), float(v)) for t, v in enumerate(y)] + [("b", float(t), 0.8 + float(rng.normal(0, 0.01))) for t in range(30)], "k string, t double, v double")
    found = {r.k_: r for r in series.single_break(x, "k", "t", "v", 0.1).toDF("k_", "n", "at", "before", "after", "shift", "disturbed").collect()}
    assert found["a"].disturbed and found["a"].before == 19 and abs(found["a"].shift + 0.4) < 0.05 and not found["b"].disturbed


def test_seasonal_break_and_quiet_series():
    t = np.arange(0, 6, 1 / 12)
    y = 0.6 + 0.15 * np.cos(2 * np.pi * t)
    assert series.harmonic_breaks(t, y) == []
    y[40:] -= 0.35
    (b,) = series.harmonic_breaks(t, y)
    assert abs(b[0] - t[40]) < 1e-9 and abs(b[1] + 0.35) < 0.02 and abs(b[2]) < 0.05


def test_every_break_is_told_and_recovery_is_that_after_the_last():
    t = np.arange(0, 30, 1 / 12)
    y = 0.6 + 0.15 * np.cos(2 * np.pi * t)
    for n, at in enumerate(range(36, 350, 36), 1):
        y[at:] -= 0.3 if n < 9 else 0.0
    y[324:] = 0.1 + 0.15 * np.cos(2 * np.pi * t[324:]) + 0.05 * (t[324:] - t[324]) + y[323]
    found = series.harmonic_breaks(t, y - 0.4 * (t >= t[324]))
    assert len(found) == 9 and all(b[2] is None for b in found[:-1]) and found[-1][2] > 0
    assert series.harmonic_breaks(t[:7], y[:7]) == [] and series.harmonic_breaks(t[:0], y[:0]) == []
    # A last stretch too short for a model has no recovery.
    y = 0.6 + 0.15 * np.cos(2 * np.pi * t)
    y[-4:] -= 0.5
    assert [b[2] for b in series.harmonic_breaks(t, y)] == [None]


class Harmonic:
    """A line and a yearly harmonic through observations that come in one after the other; only their sums are kept, so one more costs the same however many there were."""

    def __init__(self, origin: float) -> None:
        self.origin, self.n, self.squares = origin, 0, 0.0
        self.products, self.against = np.zeros((4, 4)), np.zeros(4)

    def terms(self, t: np.ndarray | float) -> np.ndarray:
        s = np.asarray(t, float) - self.origin
        return np.stack([np.ones_like(s), s, np.cos(2 * np.pi * s), np.sin(2 * np.pi * s)], axis=-1)

    def add(self, t: np.ndarray, y: np.ndarray) -> None:
        x = self.terms(t)
        self.products += x.T @ x
        self.against += y @ x
        self.squares += float(y @ y)
        self.n += len(y)
        self.weights = np.linalg.solve(self.products + 1e-9 * np.eye(4), self.against)

    def above(self, t: np.ndarray | float, y: np.ndarray | float) -> np.ndarray | float:
        return y - self.terms(t) @ self.weights

    def limit(self, k: float, drop: float) -> float:
        rest = self.squares - 2 * self.weights @ self.against + self.weights @ self.products @ self.weights
        return max(k * math.sqrt(max(rest, 0.0) / max(self.n - 4, 1)), drop)

    def change(self, years: float) -> float:
        return float(self.weights[1] * years)


def settled(t: np.ndarray, y: np.ndarray, first: int, k: float, drop: float, window: int) -> tuple[Harmonic, int, int] | None:
    """The model of the first stable window from `first` on, with where the window begins and ends: at least a year and `window` observations; trend, first and last residual within the limit."""
    ends = np.maximum(np.searchsorted(t, t + 1) + 1, np.arange(len(t)) + window)
    for begin in range(first, len(t)):
        if ends[begin] > len(t):
            return None
        own = slice(begin, ends[begin])
        model = Harmonic(t[begin])
        model.add(t[own], y[own])
        most = model.limit(k, drop)
        if abs(model.change(t[own][-1] - t[begin])) < most and np.abs(model.above(t[own][[0, -1]], y[own][[0, -1]])).max() < most:
            return model, begin, int(ends[begin])
    return None


def plain_breaks(t: np.ndarray, y: np.ndarray, k: float = 3.0, drop: float = 0.1, run: int = 3, window: int = 8) -> list[tuple[float, float, float | None]]:
    """(time, magnitude, recovery) of every break in one series: `run` observations in a row that fall short of the model by more than the limit.

    Other observations join the model. What follows a break is modelled anew; recovery, the trend over the last stretch as a share of the last
    drop, is known only for the last break, and only if its stretch has a stable model.
    """
    found: list[tuple[float, float, float | None]] = []
    at = 0
    while (fitted := settled(t, y, at, k, drop, window)) is not None:
        model, begin, end = fitted
        short: list[int] = []
        for i in range(end, len(t)):
            if model.above(t[i], y[i]) > -model.limit(k, drop):
                short.clear()
                model.add(t[i : i + 1], y[i : i + 1])
            else:
                short.append(i)
            if len(short) == run:
                break
        if len(short) < run:
            if found:
                found[-1] = (*found[-1][:2], model.change(t[-1] - t[begin]) / -found[-1][1])
            break
        at = short[0]
        found.append((float(t[at]), float(np.mean(model.above(t[short], y[short]))), None))
    return found


def uneven_series(seed, many=60):
    rng = np.random.default_rng(seed)
    for n in rng.integers(0, 130, many):
        t = np.sort(rng.uniform(0, n / 12 + 0.1, n)) if rng.random() < 0.3 else np.arange(n) / 12
        y = 0.6 + 0.15 * np.cos(2 * np.pi * t) + rng.normal(0, rng.choice([0.01, 0.05, 0.2]), n)
        for at in rng.integers(0, n + 1, rng.integers(0, 4)):
            y[at:] -= rng.uniform(-0.2, 0.6)
        yield t, y


def test_breaks_of_many_series_are_those_of_each(spark, monkeypatch):
    found = 0
    kinds = [list(uneven_series(seed)) for seed in range(4)]
    for own in kinds:
        own = [(t, y) for t, y in own if len(t)]
        first = np.cumsum([0] + [len(t) for t, _ in own[:-1]])
        got = series.breaks_of_many(np.concatenate([t for t, _ in own]), np.concatenate([y for _, y in own]), first)
        want = [(i, n, *b[:2], np.nan if b[2] is None else b[2]) for i, (t, y) in enumerate(own) for n, b in enumerate(plain_breaks(t, y), 1)]
        found += len(want)
        np.testing.assert_allclose(np.column_stack(list(got.values())), np.array(want), rtol=1e-6)
    assert found > 50
    # Series go on from batch to batch; a task follows many at once.
    rows = [(f"s{i}", float(a), float(b)) for i, (t, y) in enumerate(kinds[0]) for a, b in zip(t, y)] + [("s0", float("nan"), 1.0), (None, 1.0, 1.0)]
    want = sorted((f"s{i}", n, b[0]) for i, (t, y) in enumerate(kinds[0]) for n, b in enumerate(plain_breaks(t, y), 1))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (1, 50, 10**6):
            monkeypatch.setattr(series, "MANY", most)
            x = series.seasonal_monitor(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", "v")
            assert sorted((r[0], r.number, r["at"]) for r in x.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_hysteresis(spark):
    x = spark.createDataFrame([("a", i, h) for i, h in enumerate([0.0, 1.0, 0.5, 6.0, 5.5, 0.0])], "k string, i int, h double")
    assert tuple(series.ascent(x, "k", "i", "h", 3.0).first()) == ("a", 6.0, 6.0)


def test_polygon_with_a_hole(spark):
    rings = [("p", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])] + [("p", 1, i, x, y) for i, (x, y) in enumerate([(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)])]
    pts = spark.createDataFrame([(5.0, 5.0), (2.0, 2.0), (11.0, 1.0)], "x double, y double")
    got = vector.points_in_polygons(pts, spark.createDataFrame(rings, "polygon string, ring int, i int, x double, y double"), 3.0)
    assert [tuple(r) for r in got.collect()] == [(2.0, 2.0, "p")]


def test_areas_and_biomass(spark):
    one = spark.range(1)
    total = sum(one.select(vector.cell_area(F.lit(float(s + 1)), F.lit(float(s)), F.lit(360.0))).first()[0] for s in range(-90, 90, 30) for s in range(s, s + 30))
    assert math.isclose(total, 4 * math.pi * vector.RADIUS**2, rel_tol=1e-9)
    agb = one.select(carbon.biomass_with_height(F.lit(30.0), F.lit(20.0))).first()[0]
    assert math.isclose(agb, 0.0673 * (0.57 * 900 * 20) ** 0.976)


def test_words_match_by_beginnings_and_spelling(spark):
    assert [next(k for k in range(4) if text.within(a, b, k)) for a, b in (("ab", "ba"), ("ca", "abc"), ("", "xy"), ("same", "same"), ("elevation", "elevatoin"))] == [1, 3, 2, 0, 1]
    pairs = spark.createDataFrame([("rain", "rains", 0.0), ("elevation", "elevatoin", 0.8), ("fores", "foers", 0.8), ("forest", "forestry", 0.9), ("file", "fire", 0.0), ("slope", "slope", 1.0)], "a string, b string, want double")
    assert all(r.want == r.got for r in pairs.withColumn("got", text.match(F.col("a"), F.col("b"))).collect())
    stems = {"computing": "comput", "computes": "comput", "cities": "city", "rains": "rain", "rain": "rain", "nations": "nation"}
    x = spark.createDataFrame(list(stems), "string").withColumn("got", text.stem(F.col("value")))
    assert {r.value: r.got for r in x.collect()} == stems


def test_root_ratio_keeps_equal_rows(spark):
    x = spark.createDataFrame([("broadleaf", 75.0), ("broadleaf", 75.0), ("broadleaf", 150.0), ("conifer", 49.9), ("nowhere", 1.0)], "zone string, agb double")
    got = sorted((r.zone, r.agb, r.ratio) for r in carbon.root_ratio(x, "zone", "agb").where("ratio is not null").collect())
    assert got == [("broadleaf", 75.0, 0.23), ("broadleaf", 75.0, 0.23), ("broadleaf", 150.0, 0.23), ("conifer", 49.9, 0.4)]
    assert carbon.root_ratio(x, "zone", "agb").count() == 5


def test_interval_text(spark):
    cases = [(None, None, "irregular or unknown"), (1.05, 1.0, "daily"), (1.4, 1.0, "daily, with gaps between some records"), (6.6, None, "weekly"), (28.0, None, "monthly"), (27.0, None, "every 27 days"), (365.5, None, "yearly"), (16.5, None, "every 16.5 days")]
    x = spark.createDataFrame(cases, "d double, least double, want string").withColumn("got", dates.interval_text(F.col("d"), F.col("least")))
    assert all(r.got == r.want for r in x.collect())


def test_largest_remainder_sums(spark):
    x = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int")
    got = {r.k: r.allotted for r in stats.largest_remainder(x, "w", 100, ["k"]).collect()}
    assert got == {"a": 34, "b": 33, "c": 33}


def test_largest_remainder_without_weights(spark):
    x = spark.createDataFrame([("a", 0), ("b", 0)], "k string, w int")
    assert {r.k: r.allotted for r in stats.largest_remainder(x, "w", 1, ["k"]).collect()} == {"a": 1, "b": 0}


@pytest.mark.parametrize("name", sorted(cells.INDICES))
def test_indices_have_no_infinities(spark, name):
    bands = {k: F.lit(0.0) for k in ("nir", "red", "blue", "green", "swir1", "swir2")}
    v = spark.range(1).select(cells.index(name, **bands)).first()[0]
    assert v is None or math.isfinite(v)


def test_only_the_last_shape_of_a_place_meets_cells(spark):
    from fieldloom.operators import checks

    shapes = spark.range(6000).select(F.col("id").alias("number"), (F.col("id") % 4).alias("r"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("label"))
    last = checks.last_of_place(shapes, ["r"], "label")
    assert sorted(tuple(r) for r in last.select("r", "number", "label").collect()) == [(0, 5996, 4), (1, 5997, 5), (2, 5998, 6), (3, 5999, 0)]
    cells = spark.range(6).select(F.col("id").alias("row"), F.lit(0).alias("col"))
    inside = F.col("row").between(F.col("r"), F.col("r") + 1)
    burnt = lambda s: sorted(tuple(r) for r in checks.last_shape_wins(cells, s, inside, "label").collect())
    assert burnt(last) == burnt(shapes) == [(0, 0, 4), (1, 0, 5), (2, 0, 6), (3, 0, 0), (4, 0, 0)]
