"""Models of one series for each key: breaks, runs of anomalies, hysteresis."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def single_break(df: DataFrame, key: str, time: str, value: str, min_drop: float) -> DataFrame:
    """The key's most likely break: a line with a step against a line alone, by the Bayesian information criterion.

    Every place with two observations on either side is tried. The step's effect comes from sums alone: residuals of value and
    step on the line (Frisch, Waugh and Lovell), so no row is fitted twice and Catalyst aggregates it.
    """
    x = df.select(F.col(key).alias("key"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("y")).where("t is not null and y is not null")
    every, upto = W.partitionBy("key"), W.partitionBy("key").orderBy("t", "y").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"t": F.col("t") - F.avg("t").over(every), "at": F.col("t")})
    x = x.withColumns({"y": F.col("y") - F.avg("y").over(every)})
    s = x.withColumns({
        "n": F.count("*").over(every), "tt": F.sum(F.col("t") * F.col("t")).over(every), "ty": F.sum(F.col("t") * F.col("y")).over(every), "yy": F.sum(F.col("y") * F.col("y")).over(every),
        "k": F.count("*").over(upto), "t0": F.sum("t").over(upto), "y0": F.sum("y").over(upto), "next": F.lead("at").over(W.partitionBy("key").orderBy("t", "y")),
    })
    # Step after place k: its sum m = n - k; sums of t and y after k are the negatives of those up to it, as both are centred.
    m, st, sy = F.col("n") - F.col("k"), -F.col("t0"), -F.col("y0")
    slope = F.try_divide(F.col("ty"), F.col("tt"))
    rss0 = F.greatest(F.col("yy") - F.coalesce(slope * F.col("ty"), F.lit(0.0)), 1e-10 * F.col("n"))
    ss = m - m * m / F.col("n") - F.coalesce(F.try_divide(st * st, F.col("tt")), F.lit(0.0))
    sr = sy - F.coalesce(slope * st, F.lit(0.0))
    s = s.withColumns({"rss0": rss0, "ss": ss, "sr": sr}).where("n >= 5 and k >= 2 and n - k >= 2 and ss > 1e-9")
    s = s.withColumns({"shift": F.col("sr") / F.col("ss"), "rss1": F.greatest(F.col("yy") - F.coalesce(slope * F.col("ty"), F.lit(0.0)) - F.col("sr") * F.col("sr") / F.col("ss"), 1e-10 * F.col("n"))})
    best = s.groupBy("key").agg(F.min_by(F.struct("n", "k", "at", "next", "shift", "rss0", "rss1"), F.struct(F.round("rss1", 9), "k")).alias("b")).select("key", "b.*")
    n = F.col("n")
    hit = (n * F.ln(F.col("rss1") / n) + 4 * F.ln(n) < n * F.ln(F.col("rss0") / n) + 2 * F.ln(n)) & (F.col("shift") <= -min_drop)
    return best.select(F.col("key").alias(key), "n", "k", F.col("at").alias("before"), F.col("next").alias("after"), "shift", hit.alias("disturbed"))


def runs_of_anomalies(df: DataFrame, key: str, order: str, bad: str, least: int) -> DataFrame:
    """Runs of at least `least` consecutive bad rows of a key: first, last and length."""
    w = W.partitionBy(key).orderBy(order)
    x = df.withColumn("island", F.row_number().over(w) - F.row_number().over(W.partitionBy(key, bad).orderBy(order)))
    return x.where(F.col(bad)).groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def ascent(df: DataFrame, key: str, order: str, height: str, least: float) -> DataFrame:
    """Ascent and descent by key; the reference height follows only when the height has left it by `least`. A fold over the key's ordered heights."""
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(height).cast("double").alias("h"))))
    zero = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def step(s, p):
        d = p["h"] - s["at"]
        far = F.coalesce(F.abs(d) >= least, F.lit(False))
        return F.struct(F.when(s["at"].isNull() | far, p["h"]).otherwise(s["at"]).alias("at"), (s["up"] + F.when(far & (d > 0), d).otherwise(0.0)).alias("up"), (s["down"] + F.when(far & (d < 0), -d).otherwise(0.0)).alias("down"))

    x = df.where(F.col(height).isNotNull()).groupBy(key).agg(points.alias("points"))
    return x.select(key, F.aggregate("points", zero, step).alias("s")).select(key, F.col("s.up").alias("ascent"), F.col("s.down").alias("descent"))


class Harmonics:
    """Lines with a yearly harmonic, one a series, through observations that come in one after the other; only their sums are kept, so one more costs the same however many there were."""

    def __init__(self, many: int, k: float, drop: float) -> None:
        self.k, self.drop = k, drop
        self.origin, self.n, self.squares = np.zeros(many), np.zeros(many), np.zeros(many)
        self.products, self.against, self.weights = np.zeros((many, 4, 4)), np.zeros((many, 4)), np.zeros((many, 4))
        self.limit = np.zeros(many)

    def terms(self, own: np.ndarray, t: np.ndarray) -> np.ndarray:
        s = t - self.origin[own]
        return np.stack([np.ones_like(s), s, np.cos(2 * np.pi * s), np.sin(2 * np.pi * s)], axis=-1)

    def solve(self, own: np.ndarray) -> None:
        p, a = self.products[own], self.against[own]
        w = np.linalg.solve(p + 1e-9 * np.eye(4), a[..., None])[..., 0]
        rest = self.squares[own] - 2 * (w * a).sum(axis=1) + (w * (p @ w[..., None])[..., 0]).sum(axis=1)
        self.weights[own], self.limit[own] = w, np.maximum(self.k * np.sqrt(np.maximum(rest, 0.0) / np.maximum(self.n[own] - 4, 1)), self.drop)

    def begin(self, own: np.ndarray, t: np.ndarray, y: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Models of the observations from begin to end alone."""
        self.origin[own], self.n[own] = t[begin], end - begin
        first = np.cumsum(end - begin) - (end - begin)
        at = np.repeat(begin - first, end - begin) + np.arange(int((end - begin).sum()))
        x, v = self.terms(np.repeat(own, end - begin), t[at]), y[at]
        self.products[own] = np.add.reduceat(x[:, :, None] * x[:, None, :], first)
        self.against[own], self.squares[own] = np.add.reduceat(x * v[:, None], first), np.add.reduceat(v * v, first)
        self.solve(own)

    def add(self, own: np.ndarray, t: np.ndarray, y: np.ndarray) -> None:
        """One observation more for each of the series."""
        x = self.terms(own, t)
        self.products[own] += x[:, :, None] * x[:, None, :]
        self.against[own] += x * y[:, None]
        self.squares[own] += y * y
        self.n[own] += 1
        self.solve(own)

    def above(self, own: np.ndarray, t: np.ndarray, y: np.ndarray) -> np.ndarray:
        return y - (self.terms(own, t) * self.weights[own]).sum(axis=1)

    def change(self, own: np.ndarray, years: np.ndarray) -> np.ndarray:
        return self.weights[own, 1] * years


def breaks_of_many(t: np.ndarray, y: np.ndarray, first: np.ndarray, k: float = 3.0, drop: float = 0.1, run: int = 3, window: int = 8) -> dict[str, np.ndarray]:
    """series (its number), at, magnitude and recovery (NaN: unknown) of every break, in order, in series that stand one after the other, each from its place in `first`: `run` observations in a row that fall short of the model by more than the limit.

    A model begins with the first stable window: at least a year and `window` observations; trend, first and last residual within the limit.
    Other observations join it. What follows a break is modelled anew; recovery, the trend over the last stretch as a share of the last
    drop, is known only for the last break, and only if its stretch has a stable model. All series take a step at a time together: one window
    that is tried or one observation.
    """
    stop = np.append(first[1:], len(t))[: len(first)]
    ends = np.concatenate([a + np.maximum(np.searchsorted(t[a:b], t[a:b] + 1) + 1, np.arange(b - a) + window) for a, b in zip(first, stop, strict=True)] + [np.zeros(0, int)])
    m = Harmonics(len(first), k, drop)
    begin, at, short = first.copy(), first.copy(), np.zeros(len(first), int)
    seeking, following = np.arange(len(first)), np.zeros(0, int)
    drops, last, out, ended = np.zeros(len(first), int), np.full(len(first), np.nan), [], []
    while len(seeking) or len(following):
        seeking = seeking[begin[seeking] < stop[seeking]]
        seeking = seeking[ends[begin[seeking]] <= stop[seeking]]
        if len(seeking):
            b, e = begin[seeking], ends[begin[seeking]]
            m.begin(seeking, t, y, b, e)
            ok = np.abs(m.change(seeking, t[e - 1] - t[b])) < m.limit[seeking]
            for i in (b, e - 1):
                ok &= np.abs(m.above(seeking, t[i], y[i])) < m.limit[seeking]
            begin[seeking[~ok]] += 1
            at[seeking[ok]], short[seeking[ok]] = e[ok], 0
            following, seeking = np.concatenate([following, seeking[ok]]), seeking[~ok]
        over = at[following] == stop[following]
        if over.any():
            done = following[over]
            done = done[drops[done] > 0]
            ended.append((done, m.change(done, t[stop[done] - 1] - t[begin[done]]) / -last[done]))
            following = following[~over]
        i = at[following]
        fits = m.above(following, t[i], y[i]) > -m.limit[following]
        m.add(following[fits], t[i[fits]], y[i[fits]])
        short[following] = np.where(fits, 0, short[following] + 1)
        at[following] += 1
        broken = short[following] == run
        if broken.any():
            s = following[broken]
            begin[s] = at[s] - run
            last[s] = np.mean([m.above(s, t[begin[s] + j], y[begin[s] + j]) for j in range(run)], axis=0)
            drops[s] += 1
            out.append((s, drops[s], t[begin[s]], last[s]))
            following, seeking = following[~broken], np.concatenate([seeking, s])
    own, number, when, much = (np.concatenate(c) if out else np.zeros(0) for c in (zip(*out, strict=True) if out else [()] * 4))
    share = np.full(len(first), np.nan)
    for s, r in ended:
        share[s] = r
    order = np.lexsort((number, own))
    own, number = own[order].astype(int), number[order]
    return {"series": own, "number": number.astype(np.int32), "at": when[order], "magnitude": much[order], "recovery": np.where(number == drops[own], share[own], np.nan)}


def harmonic_breaks(t: np.ndarray, y: np.ndarray, **settings) -> list[tuple[float, float, float | None]]:
    """(time, magnitude, recovery) of every break in one series, as breaks_of_many() tells them."""
    found = breaks_of_many(np.asarray(t, float), np.asarray(y, float), np.zeros(min(len(t), 1), int), **settings)
    return [(float(a), float(b), None if math.isnan(c) else float(c)) for a, b, c in zip(found["at"], found["magnitude"], found["recovery"], strict=True)]


#: Rows from which a task follows the series it has read; the last one may go on.
MANY = 200_000


def seasonal_monitor(df: DataFrame, key: str, time: str, value: str, **settings) -> DataFrame:
    """key, number, time, magnitude and recovery of each break; many series are followed together, and one's rows must fit a task. time in years."""
    keys = df.schema[key].dataType.simpleString()

    def told(x: pd.DataFrame) -> pd.DataFrame:
        first = np.flatnonzero(x["key"].ne(x["key"].shift()).to_numpy())
        found = breaks_of_many(x["t"].to_numpy(float), x["y"].to_numpy(float), first, **settings)
        return pd.DataFrame({"key": x["key"].iloc[first[found.pop("series")]].reset_index(drop=True)} | found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, most = [], 0, MANY
        for b in batches:
            held.append(b.dropna())
            rows += len(held[-1])
            if rows >= most:
                x = pd.concat(held, ignore_index=True)
                goes_on = x["key"].eq(x["key"].iloc[-1])
                yield told(x[~goes_on])
                held = [x[goes_on]]
                rows = len(held[0])
                most = MANY + 2 * rows
        if rows:
            yield told(pd.concat(held, ignore_index=True))

    x = df.select(F.col(key).alias("key"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("y")).where("key is not null and t is not null and y is not null")
    x = x.repartition("key").sortWithinPartitions("key", "t", "y")
    return x.mapInPandas(run, f"key {keys}, number int, at double, magnitude double, recovery double").withColumnRenamed("key", key)
