"""Photos as tables of pixels: red, green, blue and alpha. Channel statistics, greenness, the nearest colour of a palette."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: pixels of less alpha are not visible.
LEAST_ALPHA = 128


def opaque(pixels: DataFrame) -> DataFrame:
    return pixels.where(F.col("alpha") >= LEAST_ALPHA)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness by Rec. 709."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def excess_green(r: Column, g: Column, b: Column) -> Column:
    """Green against red and blue as a share of the sum; 0 for black."""
    return F.when(r + g + b > 0, (2 * g - r - b) / (r + g + b)).otherwise(0.0)


def vari(r: Column, g: Column, b: Column) -> Column:
    """Atmospherically resistant greenness; null where its denominator is small or it leaves -1 to 1."""
    d = g + r - b
    v = F.when(F.abs(d) >= 1, (g - r) / d)
    return F.when((v >= -1) & (v <= 1), v)


def channel_statistics(pixels: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """By photo: visible pixels, means of the channels, luma and VARI, and the share of pixels greener than the threshold."""
    c = [F.col(k).cast("double") for k in ("red", "green", "blue")]
    x = opaque(pixels).withColumns({"luma": luma(*c), "vari": vari(*c), "green_excess": excess_green(*c)})
    return x.groupBy(*keys).agg(F.count("*").alias("pixels"), *[F.avg(k).alias(k) for k in ("red", "green", "blue", "luma", "vari")], F.avg((F.col("green_excess") > threshold).cast("int")).alias("vegetation"))


def nearest_colour(r: Column, g: Column, b: Column, palette: list[tuple[int, int, int]]) -> Column:
    """Index of the palette's nearest colour by squared distance, the first of equals. The palette is part of the expression, so no join is needed."""
    away = [F.struct(((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).alias("d"), F.lit(i).alias("i")) for i, (x, y, z) in enumerate(palette)]
    return F.array_min(F.array(*away))["i"]
