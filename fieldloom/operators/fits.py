"""Fits that take some passes over the data, each an aggregate: whether a histogram has two parts, images made alike, biomass by canopy height."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.dist import t_quantile
from fieldloom.operators.carbon import CARBON, CO2
from fieldloom.operators.cells import otsu
from fieldloom.operators.stats import finite, quantiles
from fieldloom.session import kept

#: Bins of the histogram that a mixture is fitted to.
BINS = 2048


def two_normals(at: np.ndarray, n: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and deviations of two normal parts of a histogram (values, counts), by expectation and maximisation from its split at the mean."""
    total, least = n.sum(), 1e-6 * float(np.ptp(at)) + 1e-300
    upper = (at > (n @ at) / total).astype(float)
    part, was = np.stack([1 - upper, upper]), -math.inf
    while True:
        weight = part @ n
        mean = (part * n) @ at / weight
        deviation = np.sqrt(np.maximum((part * n * (at - mean[:, None]) ** 2).sum(axis=1) / weight, least**2))
        logs = np.log(weight / total)[:, None] - np.log(deviation)[:, None] - ((at - mean[:, None]) / deviation[:, None]) ** 2 / 2
        top = logs.max(axis=0)
        like = np.exp(logs - top)
        now = float(n @ (top + np.log(like.sum(axis=0)))) / total
        part, steps = like / like.sum(axis=0), steps - 1
        if now - was < 1e-9 or not steps:
            return weight / total, mean, deviation
        was = now


def apart(df: DataFrame, value: str) -> float:
    """Ashman's D of two normal parts of the values: their distance over their spread; from 2 on, a histogram has two clear parts. A histogram of BINS rows comes to the driver."""
    v = df.select(finite(value).alias("v")).where("v is not null")
    low, high = v.agg(F.min("v"), F.max("v")).first()
    if low is None or low == high:
        return 0.0
    at = F.least(F.lit(BINS - 1), F.floor((F.col("v") - low) / (high - low) * BINS))
    h = v.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("at")).collect()
    _, mean, deviation = two_normals(np.array([r["at"] for r in h]), np.array([float(r["n"]) for r in h]))
    return float(math.sqrt(2) * abs(mean[0] - mean[1]) / math.hypot(*deviation))


def gated_threshold(df: DataFrame, value: str, plausible: tuple[float, float], default: float, least: int = 100) -> tuple[float, str]:
    """The threshold that parts the values best, if there are enough of them, they have two clear parts and it is plausible; else the default. And why: few, mixed, outside or parted."""
    v = df.select(finite(value).alias("v")).where("v is not null")
    if v.limit(least).count() < least:
        return default, "few"
    if apart(v, "v") < 2:
        return default, "mixed"
    (found,) = otsu(v, "v").first()
    return (float(found), "parted") if plausible[0] <= found <= plausible[1] else (default, "outside")


def alike(df: DataFrame, before: str, after: str, passes: int = 4) -> dict[str, float]:
    """gain, offset and spread of a line from one image's values to the other's that changed places don't pull: each pass leaves out what lies beyond 2.5 robust deviations of the last one's residuals.

    A pass is an aggregate for the line and two for the median and its deviation. The spread is a hundredth of the range at least.
    """
    x = df.select(finite(before).alias("a"), finite(after).alias("b")).where("a is not null and b is not null")
    gain, offset, middle, spread = 1.0, 0.0, 0.0, 1.0
    use = F.lit(True)
    for _ in range(passes):
        s = x.where(use).agg(F.count("*").alias("n"), F.covar_pop("a", "b").alias("ab"), F.var_pop("a").alias("aa"), F.avg("a").alias("a"), F.avg("b").alias("b")).first()
        if s.n < 10:
            break
        gain = s.ab / s.aa if s.aa * s.n > 1e-9 else 1.0
        offset = s.b - gain * s.a
        rest = F.col("b") - gain * F.col("a") - offset
        middle = quantiles(x.select(rest.alias("r")), "r", [0.5]).first().q[0]
        spread = max(1e-6, 1.4826 * quantiles(x.select(F.abs(rest - middle).alias("r")), "r", [0.5]).first().q[0])
        use = F.abs(rest - middle) < 2.5 * spread
    low, high = x.agg(F.min("b"), F.max("b")).first()
    return {"gain": gain, "offset": offset, "spread": max(spread, (high - low) * 0.01 if low is not None else 0.0, 1e-6)}


def residual(fit: dict[str, float], before: Column, after: Column) -> Column:
    """How far a value is from the fit, in spreads; 0 where one of the two is missing."""
    return F.coalesce((after - fit["gain"] * before - fit["offset"]) / fit["spread"], F.lit(0.0))


def change_magnitude(df: DataFrame, bands: list[tuple[str, str]], sensitivity: float = 3.0) -> tuple[DataFrame, float]:
    """df with magnitude, the root mean square of the bands' residuals (0 where one is missing), and changed, whether it exceeds the threshold, which is returned too: the median and `sensitivity` robust deviations (a quarter at least) of all magnitudes, 2.5 at least."""
    df = kept(df, "bands")  # some forty passes read it
    whole = F.lit(True)
    for a, b in bands:
        whole = whole & F.coalesce(finite(a).isNotNull() & finite(b).isNotNull(), F.lit(False))
    own = df.where(whole)
    total = sum(F.pow(residual(alike(own, a, b), F.col(a), F.col(b)), F.lit(2.0)) for a, b in bands)
    x = df.withColumn("magnitude", F.when(whole, F.sqrt(total / len(bands))).otherwise(0.0))
    seen = x.where(whole).select("magnitude")
    middle = quantiles(seen, "magnitude", [0.5]).first().q
    if not middle:
        return x.withColumn("changed", F.lit(False)), 2.5
    spread = 1.4826 * quantiles(seen.select(F.abs(F.col("magnitude") - middle[0]).alias("r")), "r", [0.5]).first().q[0]
    threshold = max(2.5, middle[0] + sensitivity * max(spread, 0.25))
    return x.withColumn("changed", whole & (F.col("magnitude") > threshold)), threshold


# --- Biomass by canopy height.


def height_model(plots: DataFrame, height: str, biomass: str) -> dict[str, float]:
    """A power of the height fitted on logarithms by sums alone: a (with the correction for the way back), b, log_a, spread (of the logarithms), r2, rmse, loo_rmse and what the intervals need. Plots without a positive height and biomass are left out; fewer than five raise an error.

    What a plot would be given by a model without it follows from its residual and leverage, so no plot is fitted anew.
    """
    p = plots.select(finite(height).alias("h"), finite(biomass).alias("m")).where("h > 0 and m > 0").withColumns({"x": F.log("h"), "y": F.log("m")})
    s = p.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"), F.min("h").alias("low"), F.max("h").alias("high")).first()
    if s.n < 5:
        raise ValueError(f"a model of biomass by height needs five plots or more with both; {s.n} have them")
    n, b = s.n, s.xy / s.xx
    log_a = s.y - b * s.x
    rest, lever = F.col("y") - log_a - b * F.col("x"), 1 / n + (F.col("x") - s.x) ** 2 / (n * s.xx)
    squares = p.agg(F.sum(rest * rest)).first()[0]
    spread2 = squares / (n - 2)
    without = (squares - rest * rest / (1 - lever)) / (n - 3)
    own = F.exp(spread2 / 2 + log_a + b * F.col("x")) - F.col("m")
    left = F.exp(without / 2 + F.col("y") - rest / (1 - lever)) - F.col("m")
    rmse, loo = p.agg(F.sqrt(F.avg(own * own)), F.sqrt(F.avg(left * left))).first()
    return {"plots": n, "a": math.exp(spread2 / 2 + log_a), "b": b, "log_a": log_a, "spread": math.sqrt(spread2), "r2": 1 - squares / (n * s.yy), "rmse": rmse, "loo_rmse": loo, "x": s.x, "xx": n * s.xx, "low": s.low, "high": s.high}


def biomass_of(model: dict[str, float], height: Column, least: float = 0.5) -> Column:
    """Biomass a hectare of a cell by the model, 0 below the least height, null without a height."""
    return F.when(height >= least, model["a"] * F.exp(model["b"] * F.log(height))).when(height.isNotNull(), 0.0)


def total_biomass(model: dict[str, float], cells: DataFrame, height: str, hectares: str, draws: int = 2000, seed: int = 17) -> dict[str, float]:
    """Hectares, total, its interval (95 %), carbon, carbon dioxide and the share of the area beyond the plots' heights.

    The interval draws the model's coefficients from their distribution, and the cells' own residuals by the mean and variance of their sum. Cells
    enter by classes of a five-hundredth in the logarithm of the height, some thousands at most, so draws cost nothing on the data.
    """
    c = cells.select(finite(height).alias("h"), F.col(hectares).cast("double").alias("ha")).where("h is not null")
    beyond = (F.col("h") >= 0.5) & ((F.col("h") < model["low"]) | (F.col("h") > model["high"]))
    area, total, far = c.agg(F.sum("ha"), F.sum(biomass_of(model, F.col("h")) * F.col("ha")), F.sum(F.when(beyond, F.col("ha")).otherwise(0.0))).first()
    classes = c.where("h >= 0.5").groupBy(F.floor(F.log("h") * 500).alias("k")).agg(F.avg(F.log("h")).alias("x"), F.sum("ha").alias("w"), F.sum(F.col("ha") * F.col("ha")).alias("w2")).collect()
    rng, df, s2 = np.random.default_rng(seed), model["plots"] - 2, model["spread"] ** 2
    x, w, w2 = (np.array([r[k] for r in sorted(classes)]) for k in ("x", "w", "w2"))
    scale = np.sqrt(df / rng.chisquare(df, draws)) * model["spread"]
    slope = rng.standard_normal(draws) * scale / math.sqrt(model["xx"])
    level = model["log_a"] + model["b"] * model["x"] + rng.standard_normal(draws) * scale / math.sqrt(model["plots"])
    each = np.exp(level[:, None] + (model["b"] + slope)[:, None] * (x - model["x"])[None])
    drawn = math.exp(s2 / 2) * each @ w + np.sqrt((math.exp(2 * s2) - math.exp(s2)) * (each**2 @ w2)) * rng.standard_normal(draws)
    low, high = np.percentile(drawn, [2.5, 97.5]) if len(x) else (0.0, 0.0)
    total = total or 0.0
    return {"hectares": area or 0.0, "total": total, "low": float(low), "high": float(high), "carbon": total * CARBON, "co2": total * CARBON * CO2, "beyond": far / area if area else 0.0, "t": t_quantile(0.975, df)}
