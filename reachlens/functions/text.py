"""Text clean-up, number formatting and labels for the display frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number units, largest first, and the text of a missing number.
UNITS = (
    (1e12, "lk cr"),
    (1e7, "cr"),
    (1e5, "lk"),
    (1e3, "k"),
)
NOT_AVAILABLE = "NA"

# Labels of 11 characters and more are cut to 10 with two dots after them.
LABEL_LIMIT = 11
LABEL_KEEP = 10
LABEL_ELLIPSIS = ".."


def ascii_only(text: Column) -> Column:
    """Drop every non-ASCII character; a missing text becomes empty."""
    return F.coalesce(F.regexp_replace(text, r"[^\x00-\x7F]", ""), F.lit(""))


def slug(text: Column) -> Column:
    """Keep letters, digits and underscores."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]+", "")


def spell_ampersand(text: Column) -> Column:
    return F.replace(text, F.lit("&"), F.lit("and"))


def unit_text(value: Column) -> Column:
    """Number with one decimal and an Indian unit: 123456 is ``1.2lk``."""

    def one_decimal(scaled: Column, unit: str) -> Column:
        return F.concat(F.format_number(F.round(scaled, 1), 1), F.lit(unit))

    value = value.cast("double")
    text = one_decimal(value, "")
    for size, unit in reversed(UNITS):
        text = F.when(value >= size, one_decimal(value / size, unit)).otherwise(text)
    return text


def number_text(value: Column, decimals: int) -> Column:
    """Number with thousands separators, rounded half away from zero."""
    return F.format_number(F.round(value.cast("double"), decimals), decimals)


def _cell(value: Column, raw: Column, text: Column) -> Column:
    missing = value.isNull()
    return F.struct(
        F.when(missing, F.lit("0")).otherwise(raw).alias("raw"),
        F.when(missing, F.lit(NOT_AVAILABLE)).otherwise(text).alias("text"),
    )


def share_cell(value: Column) -> Column:
    """Share: two decimals as raw value, whole number as text."""
    return _cell(value, number_text(value, 2), number_text(value, 0))


def affinity_cell(value: Column) -> Column:
    """Affinity: two decimals as raw value, whole percent as text."""
    return _cell(value, number_text(value, 2), F.concat(number_text(value, 0), F.lit("%")))


def metric_cell(value: Column) -> Column:
    """Metric: whole number as raw value, unit text as text."""
    return _cell(value, number_text(value, 0), unit_text(value))


def name_cell(value: Column, strip_after: str | None = None) -> Column:
    """Name: the full name as raw value, the short label as text."""
    return F.struct(value.alias("raw"), short_label(value, strip_after).alias("text"))


def short_label(text: Column, strip_after: str | None = None) -> Column:
    """Cut a label; with ``strip_after`` keep only what comes before that word."""
    if strip_after:
        text = F.trim(F.split_part(text, F.lit(strip_after), F.lit(1)))
    return F.when(
        F.length(text) >= LABEL_LIMIT, F.concat(F.substring(text, 1, LABEL_KEEP), F.lit(LABEL_ELLIPSIS))
    ).otherwise(text)


def pair_key(*parts: Column) -> Column:
    """Composite key text: parts joined by ``-``."""
    return F.concat_ws("-", *[part.cast("string") for part in parts])


def search_text(*parts: Column) -> Column:
    """Searchable text of a row: cleaned parts joined by spaces."""
    return F.concat_ws(" ", *[ascii_only(part) for part in parts])


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search."""
    return text.rlike(f"(?i){pattern}")


def contains(text: Column, needle: str) -> Column:
    """Case-insensitive substring search."""
    return F.lower(text).contains(needle.lower())


def sentence(template: str, *values: Column) -> Column:
    """Fill ``%s`` and ``%.2f`` style placeholders; a missing number shows as 0."""
    return F.format_string(template, *values)


def any_of(column: Column, values: Sequence[str]) -> Column:
    """Case-insensitive membership in a short list; a missing value is not a member."""
    return F.coalesce(F.lower(column).isin([value.lower() for value in values]), F.lit(False))
