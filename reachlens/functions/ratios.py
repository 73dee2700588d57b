"""Ratios that stay null instead of failing or turning infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as double; null for a null or zero whole."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def percent_of_total(part: Column, total: Column) -> Column:
    """Share of a grand total; null unless the total is positive."""
    return F.when(total > 0, percent(part, total))


def percent_or_zero(part: Column, whole: Column) -> Column:
    """Share of a total, 0 when the total is zero or missing."""
    return F.coalesce(percent(part, whole), F.lit(0.0))
