"""The table job: what the columns of a delimited file are, which of them is the time axis, and statistics, classes and trends of every number.

All that is known of the columns comes from two aggregates over the file, whatever their number; the file itself is never collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import classes, dates, metrics
from fieldloom.functions.dates import SHORT, parse_date
from fieldloom.functions.text import name_tokens
from fieldloom.operators import stats
from fieldloom.sources.files import NUMBER, present

# Names of columns that mean a time or a number of a row, and the classes of each metric.
TIME_NAMES, ROW_NAMES = r"(?i)date|time|month|year|day", ("id", "fid", "index")
LADDERS = {"ndvi": classes.NDVI, "evi": classes.EVI, "lst": classes.TEMPERATURE, "airTemp": classes.TEMPERATURE, "precip": classes.RAIN, "et": classes.EVAPOTRANSPIRATION, "solar": classes.SOLAR, "soilMoisture": classes.SOIL_MOISTURE, "humidity": classes.HUMIDITY}
#: Share of a column's filled cells that must be of a kind.
SHARE = 0.8


@dataclass
class Table:
    """rows: the typed columns and, if there is a time axis, `time_` (a date); kinds by column; metrics of the numbers; what to warn of."""

    rows: DataFrame
    kinds: dict[str, str]
    time: str | None = None
    default: str | None = None
    metrics: dict[str, str] = field(default_factory=dict)
    missing: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @property
    def numbers(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k == "number" and c != self.time]


def described(cells: DataFrame) -> Table:
    """The table of a file's cells, all of them text. Rows without a filled cell are left out.

    A column is dates if a share of its filled cells are, else numbers; the first of dates is the time axis, or the first of numbers
    with `year` in its name. Short dates are read as month first only if some day beyond 12 says so; if nothing does, day first, with a warning.
    """
    names = cells.columns
    q = lambda c: F.col(f"`{c}`")
    filled = F.lit(False)
    for c in names:
        filled = filled | present(q(c)).isNotNull()
    own = cells.where(filled)
    asked = []
    for i, c in enumerate(names):
        v = present(q(c))
        a, b = (F.regexp_extract(v, SHORT, k).try_cast("int") for k in (1, 2))
        date = parse_date(v).isNotNull() | parse_date(v, True).isNotNull()
        asked += [F.count(v).alias(f"n{i}"), F.count_if(date).alias(f"d{i}"), F.count_if(v.rlike(NUMBER)).alias(f"f{i}"), F.count_if(a > 12).alias(f"day{i}"), F.count_if(b > 12).alias(f"month{i}"), F.count_if(v.rlike(SHORT)).alias(f"s{i}")]
    r = own.agg(F.count("*").alias("rows"), *asked).first()
    if not r["rows"]:
        raise ValueError("a table needs a header and a row of data")
    words = {x.c: (x.w, x.m) for x in cells.sparkSession.createDataFrame([(c,) for c in names], "c string").select("c", name_tokens(F.col("c")).alias("w"), metrics.metric(F.col("c")).alias("m")).collect()}
    kinds = {}
    for i, c in enumerate(names):
        n = r[f"n{i}"]
        number, date = bool(n) and r[f"f{i}"] >= SHARE * n, bool(n) and r[f"d{i}"] >= SHARE * n
        # Four digits alone are a number as well as a year.
        kinds[c] = "number" if number and (not date or r[f"s{i}"] == 0 and r[f"f{i}"] >= r[f"d{i}"]) else "date" if date else "text"
    time = next((c for c in names if kinds[c] == "date"), None) or next((c for c in names if kinds[c] == "number" and "year" in words[c][0]), None)
    first = {c: r[f"month{i}"] > 0 and r[f"day{i}"] == 0 for i, c in enumerate(names)}
    typed = {"number": lambda c: F.when(present(q(c)).rlike(NUMBER), present(q(c)).try_cast("double")), "date": lambda c: parse_date(present(q(c)), first[c]), "text": lambda c: present(q(c))}
    rows = own.select(*[typed[k](c).alias(c) for c, k in kinds.items()], *([parse_date(present(q(time)), first[time]).alias("time_")] if time else []))
    t = Table(rows, kinds, time, metrics={c: words[c][1] for c in names if kinds[c] == "number"}, missing={c: r["rows"] - r[f"f{i}"] for i, c in enumerate(names) if kinds[c] == "number"})
    known = [c for c in t.numbers if t.metrics[c] != "generic"]
    plain = [c for c in t.numbers if not set(words[c][0]) & set(ROW_NAMES)]
    t.default = next(iter([*known, *plain, *t.numbers]), None)
    if time:
        i = names.index(time)
        bad = r[f"n{i}"] - rows.where("time_ is not null").count()
        if bad:
            t.warnings.append(f"{bad} values of {time} are no dates and are off the time axis")
        if r[f"s{i}"] and (r[f"day{i}"] > 0) == (r[f"month{i}"] > 0):
            t.warnings.append(f"dates of {time} could be day or month first; they are read as day first")
    else:
        odd = cells.sparkSession.createDataFrame([(i, c) for i, c in enumerate(names)], "i int, c string").where(F.col("c").rlike(TIME_NAMES)).orderBy("i").first()
        if odd:
            t.warnings.append(f"{odd.c} looks like a time, but most of its values are no dates")
        t.warnings.append("there is no time axis, so there are no trends")
    t.warnings += [f"{c} has {n} cells that are empty or no numbers" for c, n in t.missing.items() if n and c in t.numbers] or ([] if t.numbers else ["there are no numbers"])
    return t


def long_numbers(t: Table) -> DataFrame:
    """column, time_ (null without an axis) and value of all numbers of the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in t.numbers])
    x = t.rows.select(F.col("time_") if t.time else F.lit(None).cast("date").alias("time_"), F.explode(pairs).alias("p"))
    return x.select("p.column", "time_", "p.value").where("value is not null and not isnan(value)" + (" and time_ is not null" if t.time else ""))


def report(t: Table) -> DataFrame:
    """A row a number column: metric, missing, summary, first and last date, median gap in days and, from four dated values on, the trend by years; short records say so.

    Trends compare all pairs of a column's values, so this is for tables of records, not for tables of events.
    """
    x = long_numbers(t)
    out = stats.summary(x, "value", "column").join(x.groupBy("column").agg(F.min("time_").alias("first"), F.max("time_").alias("last")), "column")
    named = t.rows.sparkSession.createDataFrame([(c, t.metrics[c], t.missing[c]) for c in t.numbers], "column string, metric string, missing long")
    gaps = dates.spacing(x, "time_", "column")
    years = x.withColumn("t", dates.decimal_year(F.col("time_")))
    trend = stats.trend(years.where("t is not null"), "t", "value", "column").select("column", "s", "z", F.col("sen").alias("slope"), "direction")
    span = F.datediff("last", "first") / 365.25
    x = named.join(out, "column", "left").join(gaps, "column", "left").join(trend, "column", "left")
    return x.withColumn("short", F.when(F.col("first").isNotNull(), span < 1.9))


def class_counts(t: Table) -> DataFrame:
    """column, class and how many values of each column with a known metric it has, in the units of its classes."""
    known = [c for c in t.numbers if t.metrics[c] in LADDERS]
    if not known:
        return t.rows.sparkSession.createDataFrame([], "column string, class int, n long")
    x = long_numbers(t).where(F.col("column").isin(known))
    each = stats.quantiles(x, "value", [0.5], "column").select("column", F.col("q")[0].alias("median")).join(dates.spacing(x, "time_", "column").select("column", "median_gap"), "column", "left")
    y = x.join(F.broadcast(each), "column")  # a row a column
    found = F.when(F.lit(False), F.lit(0))
    for c in known:
        v = metrics.in_class_units(F.lit(t.metrics[c]), F.col("value"), F.col("median"), F.col("median_gap"))
        found = found.when(F.col("column") == c, classes.ladder(v, LADDERS[t.metrics[c]]))
    return y.groupBy("column", found.alias("class")).agg(F.count("*").alias("n"))
