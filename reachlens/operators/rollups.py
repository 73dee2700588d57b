"""Weekly roll-ups of the fact and the base tables that affinity is measured against."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.schemas import METRICS
from reachlens.sources.sinks import SLICE


@dataclass(frozen=True)
class Grain:
    """Keys that a roll-up groups by, and the display names that go with them."""

    keys: tuple[str, ...]
    names: tuple[str, ...]


PROGRAM = Grain(
    keys=(
        "GENRE_KEY",
        "NETWORK_KEY",
        "CHANNEL_GROUP_KEY",
        "TG_KEY",
        "MARKET_KEY",
        "WEEK_KEY",
        "ADVERTISERS_GROUP_KEY",
    ),
    names=(
        "GENRE_DISPLAY_NAME",
        "NETWORK_DISPLAY_NAME",
        "CHANNEL_GROUP_DISPLAY_NAME",
        "ADVERTISERS_GROUP_DISPLAY_NAME",
    ),
)
GENRE_CHANNEL = Grain(
    keys=("GENRE_KEY", "NETWORK_KEY", "CHANNEL_GROUP_KEY", "TG_KEY", "MARKET_KEY", "WEEK_KEY"),
    names=("GENRE_DISPLAY_NAME", "NETWORK_DISPLAY_NAME", "CHANNEL_GROUP_DISPLAY_NAME"),
)
SHOW = Grain(
    keys=("TG_KEY", "MARKET_KEY", "PROGRAM_GROUP_KEY", "CHANNEL_GROUP_KEY", "WEEK_KEY"),
    names=(
        "PROGRAM_GROUP_DISPLAY_NAME",
        "CHANNEL_GROUP_DISPLAY_NAME",
        "NETWORK_DISPLAY_NAME",
        "GENRE_DISPLAY_NAME",
    ),
)
GENRE_BASE = Grain(
    keys=("GENRE_KEY", "NETWORK_KEY", "WEEK_KEY"), names=("GENRE_DISPLAY_NAME", "NETWORK_DISPLAY_NAME")
)


def roll_up(df: DataFrame, grain: Grain, names_follow_keys: bool = False) -> DataFrame:
    """Sums of the metrics, one row per key combination, with one name per key.

    Names are grouped along with the keys first: that keeps the large aggregation a hash aggregation
    (a text ``max`` would sort every row) and combines before the shuffle. Where a key may carry
    several names, a second pass over the reduced rows keeps the greatest. ``names_follow_keys``
    skips that pass for a source whose names come from dimension tables.

    The slice of an arranged fact follows from the channel; grouping by it changes no row, keeps the arrangement, and lets rows
    stay where they are.
    """
    keys = [*grain.keys, *[name for name in (SLICE,) if name in df.columns]]
    rolled = df.groupBy(*keys, *grain.names).agg(*[F.sum(metric).alias(metric) for metric in METRICS])
    if not names_follow_keys:
        rolled = rolled.groupBy(*keys).agg(
            *[F.max(name).alias(name) for name in grain.names],
            *[F.sum(metric).alias(metric) for metric in METRICS],
        )
    return rolled.select(*keys, *grain.names, *METRICS)


def program_rollup(fact: DataFrame, names_follow_keys: bool = False) -> DataFrame:
    """Genre x network x channel x cell x week x advertiser."""
    return roll_up(fact, PROGRAM, names_follow_keys)


def genre_channel_rollup(program: DataFrame) -> DataFrame:
    """The program roll-up without the advertiser; built from that roll-up, not from the fact."""
    return roll_up(program, GENRE_CHANNEL, names_follow_keys=True)


def show_rollup(fact: DataFrame, names_follow_keys: bool = False) -> DataFrame:
    """Cell x program x channel x week."""
    return roll_up(fact, SHOW, names_follow_keys)


def at_base_cell(
    df: DataFrame, reference: DataFrame, key: str, columns: Sequence[str], unique_reference: bool = False
) -> DataFrame:
    """Rows of ``df`` that lie in the base cell of their key.

    A reference row that occurs twice doubles the rows it matches, as a plain join does;
    ``unique_reference`` removes such repeats first.
    """
    cell = [key, "TG_KEY", "MARKET_KEY"]
    base = reference.select(*cell)
    if unique_reference:
        base = base.dropDuplicates(cell)
    return df.join(base, cell).select(*columns)


def show_base(show: DataFrame, channel_reference: DataFrame, unique_reference: bool = False) -> DataFrame:
    columns = [*SHOW.keys, "PROGRAM_GROUP_DISPLAY_NAME", "CHANNEL_GROUP_DISPLAY_NAME", *METRICS]
    return at_base_cell(show, channel_reference, "CHANNEL_GROUP_KEY", columns, unique_reference)


def channel_base(genre_channel: DataFrame, channel_reference: DataFrame, unique_reference: bool = False) -> DataFrame:
    columns = [
        "CHANNEL_GROUP_KEY",
        "CHANNEL_GROUP_DISPLAY_NAME",
        "TG_KEY",
        "MARKET_KEY",
        "GENRE_KEY",
        "GENRE_DISPLAY_NAME",
        "WEEK_KEY",
        *METRICS,
    ]
    return at_base_cell(genre_channel, channel_reference, "CHANNEL_GROUP_KEY", columns, unique_reference)


def genre_base(genre_channel: DataFrame, genre_reference: DataFrame, unique_reference: bool = False) -> DataFrame:
    columns = [*GENRE_BASE.keys, *GENRE_BASE.names, *METRICS]
    in_base = at_base_cell(genre_channel, genre_reference, "GENRE_KEY", columns, unique_reference)
    return roll_up(in_base, GENRE_BASE, names_follow_keys=True)
