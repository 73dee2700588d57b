"""Week keys on tables: setting, repairing, dropping old weeks, and lookups in the date table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.functions import calendar

# Months of the older year shift, its first affected January week, and the retention span
# in week-key units (two years).
SHIFT_MONTHS = ("JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
SHIFT_JANUARY_FROM = 50
RETAINED_SPAN = 200


def set_week_key(fact: DataFrame) -> DataFrame:
    """Week key from calendar year and broadcast week."""
    return fact.withColumn("WEEK_KEY", calendar.week_key_of(F.col("CALENDAR_YEAR"), F.col("BARC_WEEK")))


def _misplaced(weeks: Sequence[int], month: str) -> Column:
    return F.col("WEEK_KEY").isin([int(week) for week in weeks]) & (F.upper("MONTH") == month)


def repair_year_end(fact: DataFrame, weeks: Sequence[int], month: str = "JAN") -> DataFrame:
    """Move January rows of the listed year-end weeks to the year before."""
    misplaced = F.coalesce(_misplaced(weeks, month), F.lit(False))
    year, key = F.col("CALENDAR_YEAR"), F.col("WEEK_KEY")
    return fact.withColumns(
        {
            "CALENDAR_YEAR": F.when(misplaced, year - 1).otherwise(year),
            "WEEK_KEY": F.when(misplaced, key - 100).otherwise(key),
        }
    )


def repaired_weeks(weeks: Sequence[int]) -> list[int]:
    """Week keys that a repair changes: the listed ones lose rows, those a year earlier gain them."""
    return sorted({int(week) for week in weeks} | {int(week) - 100 for week in weeks})


def shift_older_years(fact: DataFrame) -> DataFrame:
    """Older rule: the second half of a year, and January weeks from 50 on, belong to the year before."""
    month = F.upper("MONTH")
    older = month.isin(list(SHIFT_MONTHS)) | ((month == "JAN") & (F.col("BARC_WEEK") >= SHIFT_JANUARY_FROM))
    year = F.col("CALENDAR_YEAR")
    return fact.withColumn("CALENDAR_YEAR", F.when(F.coalesce(older, F.lit(False)), year - 1).otherwise(year))


def retain_recent(fact: DataFrame, span: int = RETAINED_SPAN) -> DataFrame:
    """Rows later than the newest week key less ``span``."""
    newest = max_week(fact).scalar()
    return fact.where(F.col("WEEK_KEY") > newest - span)


def max_week(df: DataFrame) -> DataFrame:
    return df.agg(F.max("WEEK_KEY").alias("max_week"))


def max_date(df: DataFrame) -> DataFrame:
    return df.agg(F.max("PRG_DATE").alias("max_date"))


def in_named_weeks(dates: DataFrame) -> DataFrame:
    """Rows of the date table that have a week, with their week key."""
    return dates.dropna(subset=["BARC_WEEK", "BARC_YEAR"]).withColumn(
        "WEEK_KEY", calendar.week_key_of(F.col("BARC_YEAR"), F.col("BARC_WEEK"))
    )


def last_date_keys(dates: DataFrame) -> DataFrame:
    """Key of the last day of each week, with the ``week-year`` text that looks it up."""
    weeks = in_named_weeks(dates).groupBy("BARC_YEAR", "BARC_WEEK", "WEEK_KEY")
    return weeks.agg(F.max_by("DATE_KEY", "PRG_DATE").alias("DATE_KEY")).select(
        F.concat_ws("-", F.col("BARC_WEEK").cast("string"), F.col("BARC_YEAR").cast("string")).alias("WEEK_YEAR"),
        "WEEK_KEY",
        "DATE_KEY",
    )


def date_range_keys(dates: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Keys of every day from ``first`` to ``last``; a day missing from the date table has no key."""
    day = F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))
    days = dates.sparkSession.range(1).select(F.explode(day).alias("PRG_DATE"))
    return days.join(dates.select("PRG_DATE", "DATE_KEY"), "PRG_DATE", "left")


def week_range_keys(dates: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Date keys of every week from the week of ``first`` to the week of ``last``, over any year ends."""
    first_key = calendar.week_key(F.lit(first))
    last_key = calendar.week_key(F.lit(last))
    return last_date_keys(dates).where(F.col("WEEK_KEY").between(first_key, last_key))


def default_selection(weeks: DataFrame) -> DataFrame:
    """The end date offered by default, its week key and its label, from the newest week of a table."""
    end = F.col("end_date")
    return (
        max_week(weeks)
        .select("max_week", calendar.default_end_date(F.col("max_week")).alias("end_date"))
        .select(
            "max_week",
            "end_date",
            calendar.week_key(end, "iso_year").alias("week_key"),
            calendar.week_range_label(end, end).alias("label"),
        )
    )
