"""Broadcast-week calendar as column expressions.

Weeks start on Saturday and restart on 1 January: the week number is
``floor((days since 1 January + ISO weekday of 1 January + 1) / 7)``. A week key is ``year * 100 + week``.
Two year rules are in use: ``calendar`` (the year of the date) and ``iso_year`` (the ISO year of the
date, still with the week counted from 1 January of the calendar year).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_RULES = ("calendar", "iso_year")


def week_number(day: Column) -> Column:
    """Week of the calendar year, 0 to 53."""
    new_year = F.trunc(day, "year")
    iso_weekday = F.weekday(new_year) + 1
    return F.floor((F.datediff(day, new_year) + iso_weekday + 1) / 7).cast("int")


def week_year(day: Column, year_rule: str = "calendar") -> Column:
    if year_rule not in YEAR_RULES:
        raise ValueError(f"year_rule must be one of {YEAR_RULES}")
    return F.year(day) if year_rule == "calendar" else F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def week_key(day: Column, year_rule: str = "calendar") -> Column:
    return week_key_of(week_year(day, year_rule), week_number(day))


def week_key_of(year: Column, week: Column) -> Column:
    """Week key from a year and a week number, numeric or text."""
    return (year.cast("int") * 100 + week.cast("int")).cast("int")


def week_label(day: Column, year_rule: str = "iso_year") -> Column:
    """``yyyy Week ww`` as shown next to a date selection."""
    return F.format_string("%d Week %02d", week_year(day, year_rule), week_number(day))


def week_range_label(first: Column, last: Column, year_rule: str = "iso_year") -> Column:
    return F.concat_ws(" To ", week_label(first, year_rule), week_label(last, year_rule))


def week_first_day(key: int) -> dt.date:
    """No day of this or a later week key is earlier (plain Python, for literal scan bounds)."""
    new_year = dt.date(key // 100, 1, 1)
    offset = 7 * (key % 100) - new_year.isoweekday() - 1
    return min(new_year + dt.timedelta(days=max(offset, 0)), dt.date(key // 100 + 1, 1, 1))


def week_last_day(key: int) -> dt.date:
    """No day of this or an earlier week key is later."""
    new_year = dt.date(key // 100, 1, 1)
    offset = 7 * (key % 100 + 1) - new_year.isoweekday() - 2
    return min(new_year + dt.timedelta(days=max(offset, 0)), dt.date(key // 100, 12, 31))


def default_end_date(max_week_key: Column) -> Column:
    """Saturday of the last complete week: the week before the newest week key.

    Weeks here are Sunday based (week 1 holds the first Sunday of the year). A newest key of week 00
    has no predecessor in its year, so the last week of the year before is taken.
    """
    year = F.floor(max_week_key / 100).cast("int")
    week = (max_week_key % 100).cast("int") - 1
    return F.when(week >= 0, _sunday_week_saturday(year, week)).otherwise(
        _sunday_week_saturday(year - 1, week_number(F.make_date(year - 1, F.lit(12), F.lit(31))))
    )


def _sunday_week_saturday(year: Column, week: Column) -> Column:
    first_sunday = F.next_day(F.make_date(year - 1, F.lit(12), F.lit(31)), "Sun")
    return F.date_add(first_sunday, (7 * (week - 1) + 6).cast("int"))


def date_key(day: Column) -> Column:
    """yyyymmdd as a number."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def slash_date(day: Column) -> Column:
    """yyyy/MM/dd text."""
    return F.date_format(day, "yyyy/MM/dd")


def weeks_between(first: dt.date, last: dt.date) -> int:
    """Length of a date selection in started weeks."""
    return (last - first).days // 7 + 1
