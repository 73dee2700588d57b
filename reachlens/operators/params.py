"""Request parameters: names to keys, validation against their domain, length of a period."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.functions import calendar
from reachlens.functions.text import ascii_only

# Key of an unknown name, and the longest periods of the reports.
UNKNOWN_KEY = -1
MAX_DASHBOARD_WEEKS = 52
MAX_REVENUE_DAYS = 168
MAX_RATING_WEEKS = 13


class InvalidParameter(ValueError):
    """A request parameter outside its domain."""


def names_with_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per key with its cleaned name; rows without key or name are left out.

    Rows are first counted per pair, a hash aggregation that combines before the shuffle; the count is used, else
    the optimizer would drop that step and sort every row for the text maximum.
    """
    named = df.select(F.col(key).alias("key"), F.col(name).alias("name")).dropna()
    pairs = named.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    return pairs.groupBy("key").agg(ascii_only(F.max("name")).alias("name"))


def first_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """The smallest key of each name."""
    return df.groupBy(F.col(name).alias("name")).agg(F.min(key).alias("key"))


def to_keys(chosen: DataFrame, domain: DataFrame, default: int = UNKNOWN_KEY) -> DataFrame:
    """Key of each chosen name, ``default`` for an unknown one."""
    known = first_keys(domain, "key", "name")
    return chosen.join(known, "name", "left").select("name", F.coalesce("key", F.lit(default)).alias("key"))


def to_cells(chosen: DataFrame, cells: DataFrame, default: int = UNKNOWN_KEY) -> DataFrame:
    """Audience and market key of each chosen cell text, ``default`` for an unknown one."""
    known = cells.groupBy(F.col("TG_MARKET_DISPLAY_NAME").alias("name")).agg(
        F.min(F.struct("TG_KEY", "MARKET_KEY")).alias("cell")
    )
    return chosen.join(known, "name", "left").select(
        "name",
        F.coalesce("cell.TG_KEY", F.lit(default)).alias("TG_KEY"),
        F.coalesce("cell.MARKET_KEY", F.lit(default)).alias("MARKET_KEY"),
    )


def unknown(chosen: DataFrame, domain: DataFrame) -> DataFrame:
    """Chosen (parameter, name) pairs that their parameter's domain does not contain."""
    return chosen.join(domain, ["parameter", "name"], "left_anti")


def require_known(chosen: DataFrame, domain: DataFrame) -> None:
    row = unknown(chosen, domain).first()
    if row:
        raise InvalidParameter(f"unknown {row['parameter']}: {row['name']}")


def require_weeks(first: dt.date, last: dt.date, most: int = MAX_DASHBOARD_WEEKS) -> None:
    """At most ``most`` started weeks from ``first`` to ``last``."""
    if calendar.weeks_between(first, last) > most:
        raise InvalidParameter(f"select at most {most} weeks")


def require_days(first: dt.date, last: dt.date, most: int = MAX_REVENUE_DAYS) -> None:
    """``last`` at most ``most`` days after ``first``."""
    if (last - first).days > most:
        raise InvalidParameter(f"select at most {most} days")


def period_is_valid(first: Column, last: Column, weeks: int | None = None, days: int | None = None) -> Column:
    """The same checks for a column of periods."""
    length = F.datediff(last, first)
    valid = F.lit(True)
    if weeks is not None:
        valid = valid & (F.floor(length / 7) + 1 <= weeks)
    if days is not None:
        valid = valid & (length <= days)
    return valid
