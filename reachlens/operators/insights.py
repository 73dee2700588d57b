"""Rule-based insights on an enriched frame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachlens.functions.ratios import percent_or_zero
from reachlens.functions.text import sentence
from reachlens.operators.affinity import CHANNEL, GENRE, Level

# Metric titles, insight texts and rule thresholds. ``{home}`` is the home network,
# ``{title}`` the level shown, ``{metric}`` the metric title.
METRIC_TITLES = {"ADGRP": "AD GRP", "FCT": "FCT", "TVT": "TVT"}
HOME_SHARE_TEXT = "{home} market share is %.2f%% of Total {metric}s while client spends %.2f%% on {home}"
HIGH_SPEND_TEXT = (
    "High Spend by client on low ROI competitive {title}: Spend > [{share:g}] %,"
    " and TG-Affinity < [{affinity:g}]."
)
LOW_SPEND_TEXT = (
    "Low Spend by client on high ROI {home} {title}: Spend < [{share:g}] %, and TG-Affinity > [{affinity:g}]."
)
COUNT_TEXT = "No of {title} on {home} with TG-Affinity >= {affinity:g} : %d"
COMPETITION_TEXT = (
    "Top {rows} (by Client {metric}) client spend on {title} on Competition with Affinity < {affinity:g}"
)


@dataclass(frozen=True)
class Rules:
    """Home network and thresholds of the rules."""

    home: str
    share: float = 5.0
    low_affinity: float = 50.0
    high_affinity: float = 80.0
    full_affinity: float = 100.0
    rows: int = 3

    def on_home(self) -> Column:
        """True on the home network, false elsewhere; a row without network is not on it."""
        return F.coalesce(F.col("ntwk") == self.home, F.lit(False))


COLUMNS = ("insight", "statement", "position", "category", "level", "overall_share", "affinity")


def _statement(frame: DataFrame, number: int) -> DataFrame:
    """A one-row insight without table."""
    return frame.select(
        F.lit(number).alias("insight"),
        "statement",
        F.lit(0).alias("position"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("level"),
        F.lit(None).cast("double").alias("overall_share"),
        F.lit(None).cast("double").alias("affinity"),
    )


def _ranked(rows: DataFrame, number: int, text: str, order: Column, limit: int) -> DataFrame:
    """The first rows of an order, ties by name; nothing when no row qualifies."""
    by = [order, F.col("category"), F.col("level")]
    top = rows.orderBy(*by).limit(limit).withColumn("insight", F.lit(number))
    # The window sees at most ``limit`` rows.
    position = F.row_number().over(Window.partitionBy("insight").orderBy(*by))
    return top.withColumns({"statement": F.lit(text), "position": position}).select(*COLUMNS)


def home_share(data: DataFrame, rules: Rules) -> DataFrame:
    """Share of the home network in the market and in the advertiser's spend."""
    home = rules.on_home()
    return data.agg(
        percent_or_zero(F.sum(F.when(home, F.col("prog_metric"))), F.sum("prog_metric")).alias("market_share"),
        percent_or_zero(F.sum(F.when(home, F.col("client_metric"))), F.sum("client_metric")).alias("client_share"),
    )


def high_spend_low_affinity(data: DataFrame, rules: Rules) -> DataFrame:
    """Competing rows with a large share of spend and a low affinity."""
    return data.where(
        F.col("client_metric").isNotNull()
        & ~rules.on_home()
        & (F.col("overall_share") > rules.share)
        & (F.col("affinity") < rules.low_affinity)
    )


def low_spend_high_affinity(data: DataFrame, rules: Rules) -> DataFrame:
    """Home-network rows with a small share of spend and a high affinity."""
    return data.where(
        F.col("client_metric").isNotNull()
        & rules.on_home()
        & (F.col("overall_share") < rules.share)
        & (F.col("affinity") > rules.high_affinity)
    )


def full_affinity_count(rows: DataFrame, rules: Rules) -> DataFrame:
    """Number of home-network rows with advertiser spend and full affinity."""
    counted = (
        rules.on_home() & F.col("client_metric").isNotNull() & (F.col("affinity") >= rules.full_affinity)
    )
    return rows.agg(F.count_if(counted).alias("n"))


def competing_below_full(rows: DataFrame, rules: Rules) -> DataFrame:
    """Competing rows with advertiser spend and less than full affinity."""
    return rows.where(
        F.col("client_metric").isNotNull() & ~rules.on_home() & (F.col("affinity") < rules.full_affinity)
    )


def insights(
    data: DataFrame, level: Level, metric: str, rules: Rules, channels: DataFrame | None = None
) -> DataFrame:
    """All insights in order, one row per sentence or per table row of a sentence.

    At the genre level the last two rules look at channels instead; ``channels`` is then required.
    """
    of_channels = level is GENRE
    rows = channels if of_channels else data
    title = CHANNEL.title if of_channels else level.title
    words = {"home": rules.home, "metric": METRIC_TITLES[metric], "rows": rules.rows}
    shares = home_share(data, rules).select(
        sentence(
            HOME_SHARE_TEXT.format(**words), F.round("market_share", 2), F.round("client_share", 2)
        ).alias("statement")
    )
    count = full_affinity_count(rows, rules).select(
        sentence(COUNT_TEXT.format(title=title, affinity=rules.full_affinity, **words), F.col("n")).alias("statement")
    )
    parts = [
        _statement(shares, 1),
        _ranked(
            high_spend_low_affinity(data, rules),
            2,
            HIGH_SPEND_TEXT.format(title=level.title, share=rules.share, affinity=rules.low_affinity),
            F.desc("overall_share"),
            rules.rows,
        ),
        _ranked(
            low_spend_high_affinity(data, rules),
            3,
            LOW_SPEND_TEXT.format(
                title=level.title, share=rules.share, affinity=rules.high_affinity, home=rules.home
            ),
            F.asc("overall_share"),
            rules.rows,
        ),
        _statement(count, 4),
        _ranked(
            competing_below_full(rows, rules),
            5,
            COMPETITION_TEXT.format(title=title, affinity=rules.full_affinity, **words),
            F.desc("client_metric"),
            rules.rows,
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
