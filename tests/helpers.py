"""Small frames for the tests."""

from __future__ import annotations

from decimal import Decimal

from reachlens.schemas import FACT


def fact(spark, *rows: dict):
    """Fact rows from partial dictionaries; names default to the kind and the key."""
    full = []
    for row in rows:
        row = {
            "GENRE_KEY": 1,
            "NETWORK_KEY": 1,
            "CHANNEL_GROUP_KEY": 1,
            "PROGRAM_GROUP_KEY": 1,
            "ADVERTISERS_GROUP_KEY": 1,
            "TG_KEY": 1,
            "MARKET_KEY": 1,
            "CALENDAR_YEAR": 2015,
            "BARC_WEEK": 10,
            "MONTH": "MAR",
            "WEEK_KEY": 201510,
            "ADGRP": 1,
            **row,
        }
        for kind in ("GENRE", "NETWORK", "CHANNEL_GROUP", "PROGRAM_GROUP", "ADVERTISERS_GROUP"):
            row.setdefault(f"{kind}_DISPLAY_NAME", f"{kind.lower()} {row[f'{kind}_KEY']}")
        row.setdefault("FCT", row["ADGRP"])
        row.setdefault("TVT", row["ADGRP"])
        full.append(tuple(_value(row[name], name) for name in FACT.fieldNames()))
    return spark.createDataFrame(full, FACT)


def _value(value, name):
    return Decimal(str(value)) if name in ("ADGRP", "FCT", "TVT") and value is not None else value


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    picked = [tuple(row[name] for name in columns) for row in df.collect()]
    return sorted(picked, key=lambda row: tuple((value is None, str(value)) for value in row))


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
