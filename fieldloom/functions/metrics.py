"""What a column measures, from its name, and how its values become the units of the classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import name_tokens

# Whole words and beginnings of words that tell a metric, in the order in which they are tried.
METRICS = (
    ("ndvi", ("ndvi",), ()),
    ("evi", ("evi", "evi2"), ()),
    ("lst", ("lst",), ()),
    ("precip", ("pr", "ppt"), ("precip", "rain", "prcp")),
    ("et", ("et", "aet", "pet", "eto", "et0"), ("evapo",)),
    ("solar", ("srad", "ssrd", "ghi", "rs"), ("solar", "irradian", "radiation")),
    ("soilMoisture", ("soil", "sm", "swc", "vwc", "moisture"), ("soilmoist",)),
    ("humidity", ("rh",), ("humid",)),
    ("airTemp", ("t2m", "tmean", "tmax", "tmin", "tavg"), ("temp",)),
)
LAND_SURFACE = ("land", "surface", "temp")


def metric(name: Column) -> Column:
    """The metric of a column's name; generic if none fits."""
    words = name_tokens(name)
    found = F.when(F.lit(False), F.lit(""))
    for m, whole, begins in METRICS:
        fits = _fits(words, whole, begins)
        if m == "lst":
            every = F.lit(True)
            for b in LAND_SURFACE:
                every = every & _fits(words, (), (b,))
            fits = fits | every
        found = found.when(fits, m)
    return found.otherwise("generic")


def _fits(words: Column, whole: tuple[str, ...], begins: tuple[str, ...]) -> Column:
    def one(w: Column) -> Column:
        hit = w.isin(*whole) if whole else F.lit(False)
        for b in begins:
            hit = hit | w.startswith(b)
        return hit

    return F.exists(words, one)


def in_class_units(metric: Column, value: Column, median: Column, days: Column) -> Column:
    """The value in its classes' units: scaled vegetation indices, kelvin, percent of soil moisture and totals of intervals are converted.

    median: of all of the column's values; days: the median interval between records, null without times."""
    scaled = metric.isin("ndvi", "evi") & (median > 1.5) & (median <= 10000)
    kelvin = metric.isin("lst", "airTemp") & (median > 150)
    percent = (metric == "soilMoisture") & (median > 1)
    total = (metric == "et") & (days > 1.5)
    return F.when(scaled, value / 10000).when(kelvin, value - 273.15).when(percent, value / 100).when(total, value / days).otherwise(value)


def reflectance_scale(median: Column) -> Column:
    """The factor that makes reflectances of a band whose valid values have this median."""
    return F.when(median > 1.5, 1 / 10000).otherwise(1.0)
