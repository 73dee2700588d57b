import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from reachlens.functions import calendar
from reachlens.operators import params, weeks


def plain_week(day):
    new_year = dt.date(day.year, 1, 1)
    return ((day - new_year).days + new_year.isoweekday() + 1) // 7


def all_days(spark, first, last):
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))).alias("d"))


def test_week_keys_equal_the_plain_formula(spark):
    days = all_days(spark, dt.date(1995, 1, 1), dt.date(2030, 12, 31))
    found = days.select(
        "d", calendar.week_key(F.col("d")).alias("k"), calendar.week_key(F.col("d"), "iso_year").alias("i")
    ).collect()
    assert len(found) == 13149
    for row in found:
        week = plain_week(row.d)
        assert row.k == row.d.year * 100 + week
        assert row.i == row.d.isocalendar()[0] * 100 + week


def test_year_end_dates_under_both_rules(spark):
    expected = {
        "2014-12-31": (201452, 201552),
        "2016-01-01": (201600, 201500),
        "2016-01-02": (201601, 201501),
        "2017-01-01": (201701, 201601),
        "2015-10-03": (201540, 201540),
    }
    days = spark.createDataFrame([(dt.date.fromisoformat(text),) for text in expected], "d date")
    found = days.select("d", calendar.week_key(F.col("d")).alias("k"), calendar.week_key(F.col("d"), "iso_year").alias("i"))
    assert {str(row.d): (row.k, row.i) for row in found.collect()} == expected


def test_unknown_year_rule():
    with pytest.raises(ValueError):
        calendar.week_key(F.lit(dt.date(2015, 1, 1)), "fiscal")


def test_scan_bounds_hold_every_day_of_a_week():
    day = dt.date(1995, 1, 1)
    while day.year < 2031:
        key = day.year * 100 + plain_week(day)
        assert calendar.week_first_day(key) <= day <= calendar.week_last_day(key)
        for before, after in ((key - 1, key + 1), (key - 60, key + 60)):
            assert calendar.week_first_day(before) <= day <= calendar.week_last_day(after)
        day += dt.timedelta(days=1)


def test_default_end_date_equals_sunday_week_parsing(spark):
    """Plain Python reads the key as year, Sunday-based week and Saturday."""
    keys = [year * 100 + week for year in range(1995, 2031) for week in range(2, 54)]
    frame = spark.createDataFrame([(key,) for key in keys], "k int")
    for row in frame.select("k", calendar.default_end_date(F.col("k")).alias("end")).collect():
        expected = dt.datetime.strptime(f"{row.k - 1}6", "%Y%U%w").date()
        sunday_start = dt.date(row.k // 100, 1, 1).weekday() == 6
        if not (sunday_start and row.k % 100 == 1):
            assert row.end == expected, row


def test_default_end_date_of_week_zero_is_in_the_year_before(spark):
    frame = spark.createDataFrame([(201600,)], "k int").select(calendar.default_end_date(F.col("k")).alias("end"))
    assert frame.first().end == dt.date(2015, 12, 31) + dt.timedelta(days=2)


def test_week_label(spark):
    day = F.lit(dt.date(2015, 10, 3))
    label = spark.range(1).select(calendar.week_range_label(day, F.date_add(day, 7)).alias("label")).first().label
    assert label == "2015 Week 40 To 2015 Week 41"


def test_period_limits():
    first = dt.date(2015, 1, 1)
    params.require_weeks(first, first + dt.timedelta(days=363))
    with pytest.raises(params.InvalidParameter):
        params.require_weeks(first, first + dt.timedelta(days=364))
    params.require_days(first, first + dt.timedelta(days=168))
    with pytest.raises(params.InvalidParameter):
        params.require_days(first, first + dt.timedelta(days=169))


def test_last_date_key_of_a_week(spark):
    days = all_days(spark, dt.date(2015, 1, 1), dt.date(2015, 1, 12))
    dates = days.select(
        calendar.date_key(F.col("d")).alias("DATE_KEY"),
        F.col("d").alias("PRG_DATE"),
        calendar.week_number(F.col("d")).alias("BARC_WEEK"),
        F.year("d").alias("BARC_YEAR"),
    )
    assert rows(weeks.last_date_keys(dates), "WEEK_YEAR", "DATE_KEY") == [
        ("0-2015", 20150102),
        ("1-2015", 20150109),
        ("2-2015", 20150112),
    ]


def test_week_range_crosses_a_year_with_53_weeks(spark):
    days = all_days(spark, dt.date(2016, 1, 1), dt.date(2017, 12, 31))
    dates = days.select(
        calendar.date_key(F.col("d")).alias("DATE_KEY"),
        F.col("d").alias("PRG_DATE"),
        calendar.week_number(F.col("d")).alias("BARC_WEEK"),
        F.year("d").alias("BARC_YEAR"),
    )
    found = weeks.week_range_keys(dates, dt.date(2016, 12, 20), dt.date(2017, 1, 10))
    assert [key for (key,) in rows(found, "WEEK_KEY")] == [201651, 201652, 201653, 201701, 201702]


def test_date_without_entry_has_no_key(spark):
    dates = spark.createDataFrame([(dt.date(2015, 1, 2), 20150102)], "PRG_DATE date, DATE_KEY int")
    found = weeks.date_range_keys(dates, dt.date(2015, 1, 1), dt.date(2015, 1, 2))
    assert rows(found, "PRG_DATE", "DATE_KEY") == [(dt.date(2015, 1, 1), None), (dt.date(2015, 1, 2), 20150102)]
