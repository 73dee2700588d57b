"""Totals of two audience-market cells, genre shares and affinity for one advertiser selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.functions.ratios import percent, percent_of_total
from reachlens.functions.text import ascii_only
from reachlens.schemas import METRICS


@dataclass(frozen=True)
class Level:
    """Which columns a dashboard level shows as category and level, and which tables it reads.

    ``totals``, ``client`` and ``base`` name tables of :class:`reachlens.plans.weekly.Rollups`;
    ``base_key`` is the key whose reference row names the base cell.
    """

    title: str
    level_title: str
    category: str
    level: str
    category_key: str
    level_key: str
    totals: str
    client: str
    base: str
    base_key: str


GENRE = Level(
    "Genre",
    "Network",
    "GENRE_DISPLAY_NAME",
    "NETWORK_DISPLAY_NAME",
    "GENRE_KEY",
    "NETWORK_KEY",
    "genre_channel",
    "program",
    "genre_base",
    "GENRE_KEY",
)
CHANNEL = Level(
    "Channel",
    "Genre",
    "CHANNEL_GROUP_DISPLAY_NAME",
    "GENRE_DISPLAY_NAME",
    "CHANNEL_GROUP_KEY",
    "GENRE_KEY",
    "genre_channel",
    "program",
    "channel_base",
    "CHANNEL_GROUP_KEY",
)
# The show level carries the channel key as category key and the program key as level key.
SHOW = Level(
    "Show",
    "Channel",
    "PROGRAM_GROUP_DISPLAY_NAME",
    "CHANNEL_GROUP_DISPLAY_NAME",
    "CHANNEL_GROUP_KEY",
    "PROGRAM_GROUP_KEY",
    "show",
    "fact",
    "show_base",
    "CHANNEL_GROUP_KEY",
)
LEVELS = {level.title: level for level in (GENRE, CHANNEL, SHOW)}


@dataclass(frozen=True)
class Cell:
    """One audience (TG) in one market."""

    tg: int
    market: int

    def matches(self) -> Column:
        return (F.col("TG_KEY") == int(self.tg)) & (F.col("MARKET_KEY") == int(self.market))


@dataclass(frozen=True)
class Selection:
    """An advertiser, a metric, one cell per measurement source and an inclusive week range."""

    client: int
    metric: str
    older: Cell
    newer: Cell
    start: int
    end: int

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")

    @property
    def weeks(self) -> tuple[int, int]:
        return self.start, self.end

    def in_weeks(self) -> Column:
        return F.col("WEEK_KEY").between(int(self.start), int(self.end))

    def in_cells(self) -> Column:
        return self.older.matches() | self.newer.matches()

    def of_client(self) -> Column:
        return F.col("ADVERTISERS_GROUP_KEY") == int(self.client)


# Metrics have up to seven decimal places.
EXACT_SUM = "decimal(36,7)"

# Display names that identify a row of the dashboard.
NAMES = ("category", "level", "genre", "ntwk")


def _side_by_side(selection: Selection, prefix: str = "", rows: Column | None = None) -> list[Column]:
    """Sum of the metric and number of rows per cell, as ``older``, ``newer``, ``older_rows``, ``newer_rows``."""
    metric = F.col(selection.metric)
    sums, counts = [], []
    for name, cell in (("older", selection.older), ("newer", selection.newer)):
        matches = cell.matches() if rows is None else cell.matches() & rows
        sums.append(F.sum(F.when(matches, metric)).alias(f"{prefix}{name}"))
        counts.append(F.count_if(matches).alias(f"{prefix}{name}_rows"))
    return [*sums, *counts]


def cell_sums(df: DataFrame, selection: Selection, keys: Sequence[Column]) -> DataFrame:
    """Sums of the metric per key, side by side for the two chosen cells, from one scan."""
    chosen = df.where(selection.in_weeks() & selection.in_cells())
    return chosen.groupBy(*keys).agg(*_side_by_side(selection))


def counted_once() -> Column:
    """Both cells together; equal values count once.

    The two cells are combined like a distinct union of their rows: when the same cell is chosen twice,
    or both cells have the same value for a key, that value counts a single time.
    """
    # A fixed precision: adding two decimals of the highest precision would cost them a decimal place.
    older, newer = F.col("older").cast(EXACT_SUM), F.col("newer").cast(EXACT_SUM)
    zero = F.lit(0).cast(EXACT_SUM)
    return F.when(older.eqNullSafe(newer), older).otherwise(F.coalesce(older, zero) + F.coalesce(newer, zero))


@dataclass(frozen=True)
class CellTotals:
    """Per-key sums of both cells, for all advertisers and for the chosen one.

    At levels whose table is also the source of the genre totals, ``totals`` and ``genre`` (and
    ``client`` and ``client_genre``) are the same frame, so Spark runs that aggregation once.
    """

    totals: DataFrame
    genre: DataFrame
    client: DataFrame
    client_genre: DataFrame


def _pair_columns(level: Level) -> list[Column]:
    return [
        F.col(level.category_key).alias("cat_key"),
        F.col(level.level_key).alias("level_key"),
        F.col(level.category).alias("category"),
        F.col(level.level).alias("level"),
        F.col("GENRE_DISPLAY_NAME").alias("genre"),
        F.col("NETWORK_DISPLAY_NAME").alias("ntwk"),
    ]


def cell_totals(rollups, selection: Selection, level: Level) -> CellTotals:
    """Aggregate the tables of the level to the selection.

    Genre totals always come from the genre-channel roll-up and advertiser genre totals from the
    program roll-up.
    """
    genre = F.col("GENRE_DISPLAY_NAME").alias("genre")
    columns = _pair_columns(level)
    of_client = selection.of_client()
    totals_table, client_table = getattr(rollups, level.totals), getattr(rollups, level.client)
    totals = cell_sums(totals_table, selection, columns)
    client = cell_sums(client_table.where(of_client), selection, columns)
    return CellTotals(
        totals=totals,
        genre=totals
        if totals_table is rollups.genre_channel
        else cell_sums(rollups.genre_channel, selection, [genre]),
        client=client,
        client_genre=client
        if client_table is rollups.program
        else cell_sums(rollups.program.where(of_client), selection, [genre]),
    )


def sums_of_request(fact: DataFrame, selection: Selection, level: Level) -> DataFrame:
    """Cell sums of all advertisers and of the chosen one, side by side, per row of the level.

    The tests on weeks and cells stand alone on the fact, so they reach the scans below its joins.
    """
    chosen = fact.where(selection.in_weeks() & selection.in_cells())
    sums = [*_side_by_side(selection), *_side_by_side(selection, "client_", selection.of_client())]
    return chosen.groupBy(*_pair_columns(level)).agg(*sums)


def split_sums(sums: DataFrame) -> CellTotals:
    """Cell totals from :func:`sums_of_request`."""
    keys = ["cat_key", "level_key", *NAMES]
    parts = ["older", "newer", "older_rows", "newer_rows"]
    of_client = sums.where((F.col("client_older_rows") > 0) | (F.col("client_newer_rows") > 0))
    client = of_client.select(*keys, *[F.col(f"client_{part}").alias(part) for part in parts])
    totals = sums.select(*keys, *parts)
    return CellTotals(totals=totals, genre=totals, client=client, client_genre=client)


def at_base_cells(fact: DataFrame, reference: DataFrame, level: Level) -> DataFrame:
    """Rows of the fact in the base cell of their category; once per reference row that names the cell."""
    cell = [level.base_key, "TG_KEY", "MARKET_KEY"]
    return fact.join(reference.select(*cell), cell)


def _per_key(sums: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    summed = sums.groupBy(*keys).agg(F.sum("older").alias("older"), F.sum("newer").alias("newer"))
    return summed.select(*keys, counted_once().alias(name))


def tg_affinity(cells: CellTotals) -> DataFrame:
    """Totals and advertiser totals per (category, level), next to the totals of the genre."""
    pair = ["cat_key", "level_key"]
    totals = (
        cells.totals.groupBy(*pair)
        .agg(
            *[F.max(name).alias(name) for name in NAMES],
            F.sum(counted_once()).alias("prog_metric"),
        )
    )
    return (
        totals.join(_per_key(cells.genre, ["genre"], "metric_share"), "genre")
        .join(_per_key(cells.client, pair, "client_metric"), pair, "left")
        .join(_per_key(cells.client_genre, ["genre"], "client_share"), "genre", "left")
        .select(
            "category",
            "level",
            "cat_key",
            "level_key",
            "prog_metric",
            "metric_share",
            "client_metric",
            "client_share",
            "genre",
            "ntwk",
        )
    )


def client_total(cells: CellTotals) -> Column:
    """The advertiser's grand total over all named pairs, as a scalar subquery.

    The test on the names sits inside the sum, not in a filter, so that the subquery keeps the very
    aggregation of ``cells.client`` and Spark reuses its shuffle.
    """
    named = reduce(and_, [F.col(name).isNotNull() for name in NAMES])
    per_pair = cells.client.groupBy("cat_key", "level_key").agg(
        F.sum(F.when(named, F.col("older"))).alias("older"), F.sum(F.when(named, F.col("newer"))).alias("newer")
    )
    return per_pair.agg(F.sum(counted_once())).scalar()


def channel_insights(cells: CellTotals) -> DataFrame:
    """Advertiser and total metric per channel and genre, for pairs the advertiser uses.

    ``cells`` are those of the channel level. The advertiser is matched to the totals within each
    cell, so a cell counts only where the advertiser is present, and once when both cells have the
    same pair of values. The result carries the genre key as category key.
    """
    pair = ["cat_key", "level_key"]
    parts = ["older", "newer"]
    client = cells.client.groupBy(*pair).agg(
        *[F.max(name).alias(name) for name in ("category", "level", "ntwk")],
        *[F.sum(part).alias(f"client_{part}") for part in parts],
        *[(F.sum(f"{part}_rows") > 0).alias(f"in_{part}") for part in parts],
    )
    totals = cells.totals.groupBy(*pair).agg(*[F.sum(part).alias(f"prog_{part}") for part in parts])
    both_equal = (
        F.col("in_older")
        & F.col("in_newer")
        & F.col("client_older").eqNullSafe(F.col("client_newer"))
        & F.col("prog_older").eqNullSafe(F.col("prog_newer"))
    )

    def present(kind: str) -> Column:
        older = F.when(F.col("in_older"), F.col(f"{kind}_older").cast(EXACT_SUM))
        newer = F.when(F.col("in_newer") & ~both_equal, F.col(f"{kind}_newer").cast(EXACT_SUM))
        zero = F.lit(0).cast(EXACT_SUM)
        return F.when(older.isNotNull() | newer.isNotNull(), F.coalesce(older, zero) + F.coalesce(newer, zero))

    return client.join(totals, pair).select(
        "category",
        "level",
        F.col("level_key").alias("cat_key"),
        F.col("cat_key").alias("level_key"),
        "ntwk",
        present("client").alias("client_metric"),
        present("prog").alias("prog_metric"),
    )


def affinity_denominator(base: DataFrame, selection: Selection, level: Level) -> DataFrame:
    """Metric in the base cell per (category, level) name over the chosen weeks."""
    return (
        base.where(selection.in_weeks())
        .select(
            F.col(level.category).alias("category"),
            F.col(level.level).alias("level"),
            F.col(selection.metric).alias("value"),
        )
        .dropna(subset=["category", "level"])
        .groupBy("category", "level")
        .agg(F.sum("value").alias("affinity_denom"))
    )


def by_name(affinity: DataFrame) -> DataFrame:
    """Merge keys that share their display names; genre totals are averaged, not added."""
    return (
        affinity.dropna(subset=list(NAMES))
        .groupBy(*NAMES)
        .agg(
            F.sum("prog_metric").alias("prog_metric"),
            F.avg("metric_share").alias("metric_share"),
            F.sum("client_metric").alias("client_metric"),
            F.avg("client_share").alias("client_share"),
        )
    )


def enrich(affinity: DataFrame, denominator: DataFrame, total: Column) -> DataFrame:
    """Shares and affinity per (category, level, genre, network); empty when the advertiser total is 0."""
    return (
        by_name(affinity)
        .where(F.coalesce(total, F.lit(0)) != 0)
        .join(denominator, ["category", "level"], "left")
        .select(
            ascii_only(F.col("category")).alias("category"),
            ascii_only(F.col("level")).alias("level"),
            F.col("prog_metric").cast("double").alias("prog_metric"),
            percent(F.col("prog_metric"), F.col("metric_share")).alias("genre_share"),
            percent(F.col("prog_metric"), F.col("affinity_denom")).alias("affinity"),
            F.col("client_metric").cast("double").alias("client_metric"),
            percent(F.col("client_metric"), F.col("client_share")).alias("client_genre_share"),
            percent_of_total(F.col("client_metric"), total).alias("overall_share"),
            "genre",
            "ntwk",
        )
    )


def enrich_channels(insights: DataFrame, denominator: DataFrame) -> DataFrame:
    """Share of the advertiser's spend and affinity per channel and genre."""
    names = ["category", "level", "ntwk"]
    named = (
        insights.dropna(subset=names)
        .groupBy(*names)
        .agg(F.sum("client_metric").alias("client_metric"), F.sum("prog_metric").alias("prog_metric"))
    )
    total = insights.dropna(subset=names).agg(F.sum("client_metric")).scalar()
    return named.join(denominator, ["category", "level"], "left").select(
        "category",
        "level",
        F.col("client_metric").cast("double").alias("client_metric"),
        F.col("prog_metric").cast("double").alias("prog_metric"),
        "ntwk",
        percent_of_total(F.col("client_metric"), total).alias("overall_share"),
        percent(F.col("prog_metric"), F.col("affinity_denom")).alias("affinity"),
    )


def exploration(fact: DataFrame, cell: Cell, metric: str, since_year: int, per_advertiser: bool = False) -> DataFrame:
    """Metric by genre and network in one cell, for all advertisers or per advertiser."""
    keys = ["GENRE_DISPLAY_NAME", "NETWORK_DISPLAY_NAME"]
    if per_advertiser:
        keys = ["ADVERTISERS_GROUP_DISPLAY_NAME", *keys]
    chosen = fact.where(cell.matches() & (F.col("BARC_WEEK") >= 0) & (F.col("CALENDAR_YEAR") >= since_year))
    return chosen.groupBy(*keys).agg(F.sum(metric).alias("prog_metric"))


def base_by_upper_name(
    affinity: DataFrame, reference: DataFrame, name: str, rollup: DataFrame, selection: Selection, level: Level
) -> DataFrame:
    """Older way to the denominator: base cells looked up by upper-cased name, key 0 when there is none.

    Sums the metric over both base cells of each (category key, level key) pair with advertiser value.
    """
    base_name = "level" if level is SHOW else "category"

    def cell(source_is_newer: bool, prefix: str) -> DataFrame:
        newer = F.col("SOURCE").endswith("/BARC")
        return (
            reference.where(newer if source_is_newer else ~newer)
            .select(F.upper(name).alias("base_name"), "TG_KEY", "MARKET_KEY")
            .dropna(subset=["base_name"])
            .groupBy("base_name")
            .agg(F.max("TG_KEY").alias(f"{prefix}_tg"), F.max("MARKET_KEY").alias(f"{prefix}_market"))
        )

    pairs = (
        affinity.where(F.col("client_metric").isNotNull())
        .withColumn("base_name", F.upper(base_name))
        .join(cell(False, "older"), "base_name", "left")
        .join(cell(True, "newer"), "base_name", "left")
        .fillna(0, subset=["older_tg", "older_market", "newer_tg", "newer_market"])
    )
    # Two equality joins instead of one join on "either cell"; a base cell named twice counts once.
    cells = F.array_distinct(
        F.array(
            F.struct(F.col("older_tg").alias("TG_KEY"), F.col("older_market").alias("MARKET_KEY")),
            F.struct(F.col("newer_tg").alias("TG_KEY"), F.col("newer_market").alias("MARKET_KEY")),
        )
    )
    wanted = pairs.select("category", "level", "cat_key", "level_key", F.inline(cells))
    # The distinct cells are few, the rows of all other cells are not summed.
    cells_wanted = wanted.select("TG_KEY", "MARKET_KEY").distinct()
    sums = (
        rollup.where(selection.in_weeks())
        .join(cells_wanted, ["TG_KEY", "MARKET_KEY"], "left_semi")
        .groupBy(
            F.col(level.category_key).alias("cat_key"),
            F.col(level.level_key).alias("level_key"),
            "TG_KEY",
            "MARKET_KEY",
        )
        .agg(F.sum(selection.metric).alias("value"))
    )
    return (
        wanted.join(sums, ["cat_key", "level_key", "TG_KEY", "MARKET_KEY"], "left")
        .groupBy("category", "level", "cat_key", "level_key")
        .agg(F.sum("value").alias("affinity_denom"))
    )
