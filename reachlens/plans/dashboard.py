"""A dashboard request: selection to enriched frame, insights and display frames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from reachlens.operators import affinity, insights, present
from reachlens.plans.weekly import Rollups
from reachlens.session import materialize


def enriched(tables: Rollups, selection: affinity.Selection, level: affinity.Level) -> DataFrame:
    """Totals, shares and affinity of one selection at one level."""
    cells = tables.cells(selection, level)
    return affinity.enrich(
        affinity.tg_affinity(cells), tables.denominator(selection, level), affinity.client_total(cells)
    )


def channels(tables: Rollups, selection: affinity.Selection) -> DataFrame:
    """The advertiser's channels with share of spend and affinity."""
    return affinity.enrich_channels(
        affinity.channel_insights(tables.cells(selection, affinity.CHANNEL)),
        tables.denominator(selection, affinity.CHANNEL),
    )


class Request:
    """One selection at one level; its frames are written once and shared by every consumer."""

    def __init__(self, tables: Rollups, selection: affinity.Selection, level: affinity.Level) -> None:
        self.tables = tables
        self.selection = selection
        self.level = level

    @cached_property
    def data(self) -> DataFrame:
        return materialize(enriched(self.tables, self.selection, self.level), "enriched")

    @cached_property
    def channels(self) -> DataFrame:
        return materialize(channels(self.tables, self.selection), "channels")

    @cached_property
    def shown(self) -> DataFrame:
        """Rows with bucketed networks; the show level keeps its top rows only."""
        rows = present.top_rows(self.data) if self.level is affinity.SHOW else self.data
        return materialize(present.club_others(rows), "shown")

    @cached_property
    def networks(self) -> DataFrame:
        rows = present.top_rows(self.data) if self.level is affinity.SHOW else self.data
        return present.top_networks(rows)

    def insights(self, rules: insights.Rules) -> DataFrame:
        of_channels = self.channels if self.level is affinity.GENRE else None
        return insights.insights(self.data, self.level, self.selection.metric, rules, of_channels)
