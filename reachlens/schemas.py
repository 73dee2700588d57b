"""Logical tables: one explicit schema per table, column order as delivered."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = ("ADGRP", "FCT", "TVT")

# Measurement-source codes.
SOURCE_OLDER = "CUST_SALES"
SOURCE_NEWER = "CUST_SALES/BARC"

_MEASURE = T.DecimalType(22, 7)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FACT = _struct(
    GENRE_KEY=T.IntegerType(),
    GENRE_DISPLAY_NAME=T.StringType(),
    NETWORK_KEY=T.IntegerType(),
    NETWORK_DISPLAY_NAME=T.StringType(),
    CHANNEL_GROUP_KEY=T.LongType(),
    CHANNEL_GROUP_DISPLAY_NAME=T.StringType(),
    PROGRAM_GROUP_KEY=T.LongType(),
    PROGRAM_GROUP_DISPLAY_NAME=T.StringType(),
    ADVERTISERS_GROUP_KEY=T.IntegerType(),
    ADVERTISERS_GROUP_DISPLAY_NAME=T.StringType(),
    TG_KEY=T.IntegerType(),
    MARKET_KEY=T.IntegerType(),
    CALENDAR_YEAR=T.IntegerType(),
    BARC_WEEK=T.IntegerType(),
    MONTH=T.StringType(),
    WEEK_KEY=T.IntegerType(),
    ADGRP=_MEASURE,
    FCT=_MEASURE,
    TVT=_MEASURE,
)

REF_GENRE_TG_MKT = _struct(
    GENRE_KEY=T.IntegerType(),
    GENRE_NAME=T.StringType(),
    GENRE_DISPLAY_NAME=T.StringType(),
    TG_KEY=T.IntegerType(),
    MARKET_KEY=T.IntegerType(),
    SOURCE=T.StringType(),
    TG_MARKET_DISPLAY_NAME=T.StringType(),
)

REF_CH_GROUP_TG_MKT = _struct(
    CHANNEL_GROUP_KEY=T.LongType(),
    CHANNEL_GROUP_DISPLAY_NAME=T.StringType(),
    TG_KEY=T.IntegerType(),
    MARKET_KEY=T.IntegerType(),
    SOURCE=T.StringType(),
    TG_MARKET_DISPLAY_NAME=T.StringType(),
    TG_DISPLAY_NAME=T.StringType(),
    MARKET_DISPLAY_NAME=T.StringType(),
)

REF_TG_MKT = _struct(
    TG_DISPLAY_NAME=T.StringType(),
    MARKET_DISPLAY_NAME=T.StringType(),
    TG_MARKET_DISPLAY_NAME=T.StringType(),
    TG_KEY=T.IntegerType(),
    MARKET_KEY=T.IntegerType(),
    SOURCE=T.StringType(),
)

DIM_DATE = _struct(
    DATE_KEY=T.IntegerType(),
    PRG_DATE=T.DateType(),
    BARC_WEEK=T.IntegerType(),
    BARC_YEAR=T.IntegerType(),
)

DIM_CHANNEL_GROUP = _struct(
    CHANNEL_GROUP_KEY=T.LongType(),
    CHANNEL_GROUP_DISPLAY_NAME=T.StringType(),
)

REF_EMPLOYEE_HIERARCHY = _struct(
    EMPLOYEE_KEY=T.StringType(),
    EMPLOYEE_NT_ID=T.StringType(),
    EMPLOYEE_NAME=T.StringType(),
    EMPLOYEE_ROLE=T.StringType(),
    SECONDARY_ROLE=T.StringType(),
    MANAGER_NAME=T.StringType(),
    AUTH_GROUP=T.StringType(),
)

REF_EMPLOYEE_ACCESS = _struct(
    EMPLOYEE_KEY=T.StringType(),
    CHANNEL_GROUP_KEY=T.StringType(),
    CHANNEL_GROUP_DISPLAY_NAME=T.StringType(),
    LOCATION_KEY=T.StringType(),
)

NEWS_KEY = ("Title", "PublishDate", "Link", "Source", "SearchTerm")

NEWS = _struct(
    Title=T.StringType(),
    PublishDate=T.TimestampNTZType(),
    Link=T.StringType(),
    Source=T.StringType(),
    SearchTerm=T.StringType(),
)

# The archive is partitioned by day of publication.
ARCHIVE_DAY = "PublishDay"
ARCHIVE = T.StructType([*NEWS.fields, T.StructField(ARCHIVE_DAY, T.DateType())])

# The header-less news file keeps the publish date as the feed wrote it.
NEWS_TEXT = _struct(**{name: T.StringType() for name in NEWS_KEY})

NETWORK_COLORS = _struct(Network=T.StringType(), HexCode=T.StringType())

SEARCH_TERMS = _struct(term=T.StringType())

# One feed as fetched: the term it was fetched for and the whole document.
FEED = _struct(SearchTerm=T.StringType(), feed_no=T.LongType(), document=T.StringType())
