"""The table job on small files of text."""

import datetime

import pytest

from fieldloom.operators import tables


def file(spark, header, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))


def test_month_first_dates_make_the_time_axis(spark):
    t = tables.described(file(spark, ["Date", "NDVI", "id"], [("01/02/2020", "0.2", "1"), ("02/13/2020", "n/a", "2"), ("03/01/2020", "0.4", "3"), ("", " ", None), ("02/30/2020", "0.5", "4"), ("04/01/2020", "0.6", "5")]))
    assert t.kinds == {"Date": "date", "NDVI": "number", "id": "number"} and (t.time, t.default, t.metrics["NDVI"]) == ("Date", "NDVI", "ndvi")
    assert [r.time_ for r in t.rows.collect()] == [datetime.date(2020, 1, 2), datetime.date(2020, 2, 13), datetime.date(2020, 3, 1), None, datetime.date(2020, 4, 1)]
    assert t.warnings == ["1 values of Date are no dates and are off the time axis", "NDVI has 1 cells that are empty or no numbers"]


def test_ambiguous_and_missing_time_axes(spark):
    t = tables.described(file(spark, ["when", "v"], [("01/02/2020", "1"), ("03/04/2020", "2")]))
    assert any("day or month first" in w for w in t.warnings) and t.rows.first().time_ == datetime.date(2020, 2, 1)
    t = tables.described(file(spark, ["Year", "v"], [("1999", "1"), ("2000", "2")]))
    assert t.time == "Year" and t.numbers == ["v"] and t.rows.first().time_ == datetime.date(1999, 1, 1)
    t = tables.described(file(spark, ["date seen", "a"], [("x", "b"), ("y", "c")]))
    assert t.time is None and len(t.warnings) == 3 and t.default is None
    with pytest.raises(ValueError, match="row of data"):
        tables.described(file(spark, ["a"], [(" ",), (None,)]))


def test_report(spark):
    rows = [(f"{y}-{m:02d}-01", f"{y - 2000 + m / 100}", "7") for y in (2001, 2002, 2003) for m in range(1, 13)]
    t = tables.described(file(spark, ["time", "air temp", "k"], rows))
    got = {r.column: r for r in tables.report(t).collect()}
    assert (got["air temp"].metric, got["air temp"].n, got["air temp"].direction, got["air temp"].short) == ("airTemp", 36, "rising", False)
    assert got["k"].direction == "none" and got["k"].sd == 0 and got["air temp"].median_gap == 31
    assert {(r.column, r["class"], r.n) for r in tables.class_counts(t).collect()} == {("air temp", 1, 36)}
    t = tables.described(file(spark, ["a", "b"], [("1", "x"), ("3", "y")]))
    r = tables.report(t).first()
    assert (r.column, r["mean"], r["first"], r.s) == ("a", 2.0, None, None) and tables.class_counts(t).count() == 0
