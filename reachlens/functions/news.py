"""Fields of a news item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of a feed date, the mark-up around the source name in a description, the mark-up of an
# item, and the notice of a term without items.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SOURCE_PATTERN = '<font color="#6f6f6f">([^<]*)</font>'
ANCHOR = '<a target = "blank" class="tab" href="%s">%s</a>'
NO_DATA = "No Data Available"

_FEED_DATE = r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) \w+$"


def feed_date(text: Column) -> Column:
    """``Fri, 25 Sep 2015 17:04:04 GMT`` as a timestamp without zone; null when it is not such a date.

    The zone name is read and ignored, so the result does not depend on the session time zone.
    """
    day, month, year, time = (F.regexp_extract(text, _FEED_DATE, group) for group in range(1, 5))
    month_no = F.array_position(F.array(*[F.lit(name) for name in MONTHS]), month)
    iso = F.format_string("%s-%02d-%s %s", year, month_no, F.lpad(day, 2, "0"), time)
    return F.when(month_no > 0, iso.try_cast("timestamp_ntz"))


def link_target(link: Column) -> Column:
    """The part of a feed link after ``url=``; null when there is none."""
    return F.nullif(F.split_part(link, F.lit("url="), F.lit(2)), F.lit(""))


def source_name(description: Column) -> Column:
    """Source from the colored font tag of a description."""
    return F.regexp_extract(description, SOURCE_PATTERN, 1)


def anchor(title: Column, link: Column) -> Column:
    return F.format_string(ANCHOR, link, title)


def compact_term(term: Column) -> Column:
    """Search term without spaces, as kept next to the fetched items."""
    return F.replace(term, F.lit(" "), F.lit(""))


def query_term(term: Column) -> Column:
    """Search term as looked up: lower case, no quotation marks, percent-encoded."""
    plain = F.regexp_replace(F.lower(term), "['\"]", "")
    encoded = F.url_encode(plain)
    for java_form, percent_form in (("+", "%20"), ("%2F", "/"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(java_form), F.lit(percent_form))
    return encoded
