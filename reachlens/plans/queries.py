"""Registered queries: each takes a session and a table folder and returns one result frame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlens.functions import calendar, text
from reachlens.functions import news as news_functions
from reachlens.operators import affinity, insights, news, params, present, rollups, scope, weeks
from reachlens.plans import dashboard, weekly
from reachlens.schemas import METRICS, NEWS_KEY, REF_CH_GROUP_TG_MKT, SOURCE_NEWER
from reachlens.session import materialize, scratch_path
from reachlens.sources import files, mapping, sinks
from reachlens.sources.builds import Builds
from reachlens.streaming import news_archive

# Example selection of the dashboard queries.
SELECTION = affinity.Selection(
    client=3,
    metric="ADGRP",
    older=affinity.Cell(1, 1),
    newer=affinity.Cell(12, 1),
    start=199601,
    end=199652,
)

# The network that plays the home network, with the usual thresholds.
RULES = insights.Rules(home="NATION_7")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _build(spark: SparkSession, folder: str) -> weekly.Rollups:
    return weekly.Rollups(
        mapping.fact(spark, folder),
        mapping.ref_genre_tg_mkt(spark, folder),
        mapping.ref_ch_group_tg_mkt(spark, folder),
        names_follow_keys=True,
    )


def _request(spark: SparkSession, folder: str, selection: affinity.Selection = SELECTION) -> weekly.Rollups:
    genres, channels = mapping.ref_genre_tg_mkt(spark, folder), mapping.ref_ch_group_tg_mkt(spark, folder)
    return weekly.FactOnly(
        mapping.fact(spark, folder, selection.weeks),
        genres,
        channels,
        lambda level: mapping.fact(
            spark, folder, selection.weeks, base_cells=genres if level is affinity.GENRE else channels
        ),
    )


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Decimal sums as doubles, for the comparison of results."""
    return df.withColumns({name: F.col(name).cast("double") for name in columns})


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in columns})


# --- weekly roll-ups ---


def _program(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.program_rollup(mapping.fact(spark, folder), names_follow_keys=True)


def _genre_channel(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.genre_channel_rollup(_program(spark, folder))


@register
def prog_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_program(spark, folder), *METRICS)


@register
def genre_channel_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_genre_channel(spark, folder), *METRICS)


@register
def show_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(rollups.show_rollup(mapping.fact(spark, folder), names_follow_keys=True), *METRICS)


@register
def show_affinity_base(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_build(spark, folder).show_base, *METRICS)


@register
def channel_affinity_base(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_build(spark, folder).channel_base, *METRICS)


@register
def genre_affinity_base(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_build(spark, folder).genre_base, *METRICS)


# --- affinity query ---

_AFFINITY_VALUES = ("prog_metric", "metric_share", "client_metric", "client_share")
_SHARES = ("genre_share", "affinity", "client_genre_share", "overall_share")


def _affinity(
    spark: SparkSession, folder: str, level: affinity.Level, selection: affinity.Selection = SELECTION
) -> DataFrame:
    return affinity.tg_affinity(_request(spark, folder, selection).cells(selection, level))


def _enriched(spark: SparkSession, folder: str, level: affinity.Level) -> DataFrame:
    return dashboard.enriched(_request(spark, folder), SELECTION, level)


@register
def affinity_genre(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_affinity(spark, folder, affinity.GENRE), *_AFFINITY_VALUES)


@register
def affinity_channel(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_affinity(spark, folder, affinity.CHANNEL), *_AFFINITY_VALUES)


@register
def affinity_show(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_affinity(spark, folder, affinity.SHOW), *_AFFINITY_VALUES)


@register
def affinity_genre_fct(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_affinity(spark, folder, affinity.GENRE, replace(SELECTION, metric="FCT")), *_AFFINITY_VALUES)


@register
def affinity_genre_tvt(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_affinity(spark, folder, affinity.GENRE, replace(SELECTION, metric="TVT")), *_AFFINITY_VALUES)


@register
def enriched_genre(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_enriched(spark, folder, affinity.GENRE), *_SHARES)


@register
def enriched_channel(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_enriched(spark, folder, affinity.CHANNEL), *_SHARES)


@register
def enriched_show_top100(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(present.top_rows(_enriched(spark, folder, affinity.SHOW)), *_SHARES)


@register
def enriched_show_by_total(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(present.top_rows_by_total(_enriched(spark, folder, affinity.SHOW)), *_SHARES)


@register
def affinity_same_cell_twice(spark: SparkSession, folder: str) -> DataFrame:
    twice = replace(SELECTION, newer=SELECTION.older)
    return _doubles(_affinity(spark, folder, affinity.GENRE, twice), *_AFFINITY_VALUES)


@register
def channel_insights(spark: SparkSession, folder: str) -> DataFrame:
    frame = affinity.channel_insights(_request(spark, folder).cells(SELECTION, affinity.CHANNEL))
    return _doubles(frame, "client_metric", "prog_metric")


@register
def channel_insights_enriched(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(dashboard.channels(_request(spark, folder), SELECTION), "overall_share", "affinity")


@register
def base_by_upper_name(spark: SparkSession, folder: str) -> DataFrame:
    frame = affinity.base_by_upper_name(
        _affinity(spark, folder, affinity.GENRE),
        mapping.ref_genre_tg_mkt(spark, folder),
        "GENRE_NAME",
        mapping.fact(spark, folder, SELECTION.weeks),
        SELECTION,
        affinity.GENRE,
    )
    return _doubles(frame, "affinity_denom")


def _explored(spark: SparkSession, folder: str, per_advertiser: bool) -> DataFrame:
    """Names are looked up among the base cells first; keys and year then reach the scans."""
    reference = mapping.ref_ch_group_tg_mkt(spark, folder)
    chosen = spark.createDataFrame([("TG 1 MKT 1",)], "name string")
    found = params.to_cells(chosen, reference).first()
    cell = affinity.Cell(found["TG_KEY"], found["MARKET_KEY"])
    fact = mapping.fact(spark, folder, since=dt.date(1997, 1, 1))
    return _doubles(affinity.exploration(fact, cell, "ADGRP", 1997, per_advertiser), "prog_metric")


@register
def exploration_all(spark: SparkSession, folder: str) -> DataFrame:
    return _explored(spark, folder, per_advertiser=False)


@register
def exploration_per_advertiser(spark: SparkSession, folder: str) -> DataFrame:
    return _explored(spark, folder, per_advertiser=True)


# --- insights ---


def _dashboard(spark: SparkSession, folder: str, level: affinity.Level) -> dashboard.Request:
    return dashboard.Request(_request(spark, folder), SELECTION, level)


@register
def insight_home_share(spark: SparkSession, folder: str) -> DataFrame:
    frame = insights.home_share(_enriched(spark, folder, affinity.GENRE), RULES)
    return _rounded(frame, "market_share", "client_share")


@register
def insight_high_spend_low_affinity(spark: SparkSession, folder: str) -> DataFrame:
    rules = replace(RULES, share=3.0, low_affinity=80.0)
    rows = insights.high_spend_low_affinity(_enriched(spark, folder, affinity.GENRE), rules)
    top = rows.orderBy(F.desc("overall_share"), "category", "level").limit(3)
    return _rounded(top.select("category", "level", "overall_share", "affinity"), "overall_share", "affinity")


@register
def insight_low_spend_high_affinity(spark: SparkSession, folder: str) -> DataFrame:
    rows = insights.low_spend_high_affinity(_enriched(spark, folder, affinity.CHANNEL), RULES)
    top = rows.orderBy(F.asc("overall_share"), "category", "level").limit(3)
    return _rounded(top.select("category", "level", "overall_share", "affinity"), "overall_share", "affinity")


@register
def insight_affinity_count(spark: SparkSession, folder: str) -> DataFrame:
    channels = dashboard.channels(_request(spark, folder), SELECTION)
    return insights.full_affinity_count(channels, RULES)


@register
def insight_top_competitor(spark: SparkSession, folder: str) -> DataFrame:
    channels = dashboard.channels(_request(spark, folder), SELECTION)
    rows = insights.competing_below_full(channels, RULES)
    top = rows.orderBy(F.desc("client_metric"), "category", "level").limit(3)
    return _rounded(top.select("category", "level", "overall_share", "affinity"), "overall_share", "affinity")


@register
def insight_list_genre(spark: SparkSession, folder: str) -> DataFrame:
    frame = _dashboard(spark, folder, affinity.GENRE).insights(RULES)
    return _rounded(frame, "overall_share", "affinity")


@register
def insight_list_channel(spark: SparkSession, folder: str) -> DataFrame:
    frame = _dashboard(spark, folder, affinity.CHANNEL).insights(RULES)
    return _rounded(frame, "overall_share", "affinity")


@register
def insight_list_show(spark: SparkSession, folder: str) -> DataFrame:
    frame = _dashboard(spark, folder, affinity.SHOW).insights(RULES)
    return _rounded(frame, "overall_share", "affinity")


# --- display frames ---


@register
def top_networks(spark: SparkSession, folder: str) -> DataFrame:
    return present.top_networks(_enriched(spark, folder, affinity.CHANNEL))


@register
def club_others(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_dashboard(spark, folder, affinity.CHANNEL).shown, *present.VALUES)


@register
def club_others_show(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_dashboard(spark, folder, affinity.SHOW).shown, *present.VALUES)


@register
def axis_extents(spark: SparkSession, folder: str) -> DataFrame:
    extents = present.axis_extents(_dashboard(spark, folder, affinity.CHANNEL).shown)
    return _rounded(extents, *extents.columns)


@register
def axis_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dashboard(spark, folder, affinity.CHANNEL).shown
    return _rounded(present.axis_range(rows, x_lo=50.0, y_hi=900.5), *present.VALUES)


@register
def axis_range_default(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dashboard(spark, folder, affinity.CHANNEL).shown
    return _rounded(present.axis_range(rows), *present.VALUES)


@register
def unit_format(spark: SparkSession, folder: str) -> DataFrame:
    """Spend per advertiser and for all of them, large enough for every unit."""
    spend = mapping.fact(spark, folder).groupBy("ADVERTISERS_GROUP_KEY")
    values = spend.agg(F.sum("FCT").alias("fct"), F.sum("ADGRP").alias("adgrp")).select(
        "ADVERTISERS_GROUP_KEY",
        F.col("fct").cast("double").alias("fct"),
        F.col("adgrp").cast("double").alias("adgrp"),
    )
    return values.select(
        "ADVERTISERS_GROUP_KEY",
        text.unit_text(F.col("fct") * 100000).alias("huge"),
        text.unit_text(F.col("fct")).alias("fct"),
        text.unit_text(F.col("adgrp")).alias("adgrp"),
        text.unit_text(F.col("adgrp") / 100).alias("hundredth"),
        text.unit_text(F.col("adgrp") / 1e6).alias("tiny"),
    )


@register
def cell_format(spark: SparkSession, folder: str) -> DataFrame:
    cells = present.formatted(_dashboard(spark, folder, affinity.GENRE).shown, affinity.GENRE)
    structs = ["category", "level", *present.VALUES]
    flat = [F.col(f"{name}.{part}").alias(f"{name}_{part}") for name in structs for part in ("raw", "text")]
    bars = [F.round(f"{name}_bar", 6).alias(f"{name}_bar") for name in present.SHARES if name != "affinity"]
    return cells.select(*flat, *bars, "row_slug", "search")


@register
def bubbles(spark: SparkSession, folder: str) -> DataFrame:
    request = _dashboard(spark, folder, affinity.CHANNEL)
    colors = mapping.network_colors(spark, folder).withColumn("Network", F.lower("Network"))
    frame = present.bubbles(request.shown, request.networks, colors)
    return _rounded(frame, "x", "y", "radius")


@register
def search_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = present.search(_dashboard(spark, folder, affinity.CHANNEL).shown, "economy|nation_1[0-5]")
    return rows.select(*present.NAMES)


@register
def pick_list_search(spark: SparkSession, folder: str) -> DataFrame:
    channels = mapping.dim_channel_group(spark, folder)
    return channels.where(text.contains(F.col("CHANNEL_GROUP_DISPLAY_NAME"), "supplier#0000000"))


@register
def base_market_pivot(spark: SparkSession, folder: str) -> DataFrame:
    markets = present.base_markets(mapping.ref_ch_group_tg_mkt(spark, folder), "CHANNEL_GROUP_DISPLAY_NAME")
    return markets.select(
        "name",
        "tam",
        "barc",
        present.base_text(201512).alias("shown_before"),
        present.base_text(201513).alias("shown_after"),
    )


@register
def base_market_pivot_genre(spark: SparkSession, folder: str) -> DataFrame:
    return present.base_markets(mapping.ref_genre_tg_mkt(spark, folder), "GENRE_DISPLAY_NAME")


@register
def download_export(spark: SparkSession, folder: str) -> DataFrame:
    """Write the export as CSV and read it back."""
    rows = present.export_rows(_enriched(spark, folder, affinity.CHANNEL), affinity.CHANNEL, SELECTION.metric)
    path = scratch_path(spark, "export")
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@register
def download_export_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The export with its leading rows: what was selected, then titles and values, in the order of the file."""
    level = affinity.CHANNEL
    client = mapping.table(spark, folder, "nation").where(F.col("n_nationkey") == SELECTION.client).select("n_name")
    chosen = {
        "Client": client.first()[0],
        "Metric": SELECTION.metric,
        "Period": f"{SELECTION.start} - {SELECTION.end}",
        "Level": level.title,
    }
    rows = present.export_rows(_enriched(spark, folder, level), level, SELECTION.metric)
    return present.export_with_selection(rows, chosen)


# --- calendar and week keys ---

REPAIRED_WEEKS = (199552, 199653, 199752, 199953, 200052)


def _fact_by_week(fact: DataFrame) -> DataFrame:
    sums = fact.groupBy("CALENDAR_YEAR", "MONTH", "WEEK_KEY").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(metric).alias(metric) for metric in METRICS]
    )
    return _doubles(sums, *METRICS)


@register
def week_key_from_date(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("day")
    days = mapping.table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.select(
        "day",
        calendar.week_number(day).alias("week"),
        calendar.week_key(day).alias("week_key"),
        calendar.week_key(day, "iso_year").alias("week_key_iso_year"),
        calendar.week_range_label(day, F.date_add(day, 7)).alias("label"),
        calendar.slash_date(day).alias("slash_date"),
    )


@register
def week_repair(spark: SparkSession, folder: str) -> DataFrame:
    fact = weeks.set_week_key(mapping.spots(spark, folder))
    return _fact_by_week(weeks.repair_year_end(fact, REPAIRED_WEEKS))


@register
def week_shift_older(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_by_week(weeks.set_week_key(weeks.shift_older_years(mapping.spots(spark, folder))))


@register
def week_retention(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_by_week(weeks.retain_recent(mapping.spots(spark, folder)))


@register
def max_week(spark: SparkSession, folder: str) -> DataFrame:
    return weeks.max_week(mapping.spots(spark, folder))


@register
def default_end_date(spark: SparkSession, folder: str) -> DataFrame:
    return weeks.default_selection(mapping.spots(spark, folder))


@register
def end_date_per_week(spark: SparkSession, folder: str) -> DataFrame:
    """The default end date for every week that could be the newest one."""
    keys = mapping.spots(spark, folder).select("WEEK_KEY").distinct()
    return keys.select("WEEK_KEY", calendar.default_end_date(F.col("WEEK_KEY")).alias("end_date"))


@register
def latest_dates(spark: SparkSession, folder: str) -> DataFrame:
    orders = mapping.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("PRG_DATE"))
    revenue = weeks.max_date(orders).select(F.lit("revenue").alias("fact"), "max_date")
    breaks = weeks.max_date(mapping.fact_cust_break_agg_dly(spark, folder)).select(F.lit("break").alias("fact"), "max_date")
    return revenue.unionByName(breaks)


@register
def latest_dates_from_footers(spark: SparkSession, folder: str) -> DataFrame:
    """The same dates from daily tables on disk, whose footers have the maxima."""
    orders = mapping.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("PRG_DATE"))
    found = []
    for name, dates in (("revenue", orders), ("break", mapping.fact_cust_break_agg_dly(spark, folder))):
        path = scratch_path(spark, name)
        dates.write.parquet(path)
        found.append(weeks.max_date(files.with_footers(spark, path)).select(F.lit(name).alias("fact"), "max_date"))
    return found[0].unionByName(found[1])


@register
def week_to_date_key(spark: SparkSession, folder: str) -> DataFrame:
    return weeks.last_date_keys(mapping.dim_date(spark, folder))


@register
def date_range_keys(spark: SparkSession, folder: str) -> DataFrame:
    return weeks.date_range_keys(mapping.dim_date(spark, folder), dt.date(1996, 11, 20), dt.date(1997, 2, 14))


@register
def week_range_keys(spark: SparkSession, folder: str) -> DataFrame:
    return weeks.week_range_keys(mapping.dim_date(spark, folder), dt.date(1996, 11, 20), dt.date(1997, 2, 14))


@register
def period_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Which order-to-shipment periods a report would accept."""
    orders = mapping.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    first, last = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    periods = mapping.table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate").join(orders, "l_orderkey")
    return periods.groupBy(
        params.period_is_valid(first, last, weeks=params.MAX_DASHBOARD_WEEKS).alias("dashboard"),
        params.period_is_valid(first, last, days=params.MAX_REVENUE_DAYS).alias("revenue"),
        params.period_is_valid(first, last, weeks=params.MAX_RATING_WEEKS).alias("ratings"),
    ).agg(F.count(F.lit(1)).alias("n"))


# --- tables ---


_GENRE_TABLES = ("program", "genre_channel", "genre_base")


def _weekly(spark: SparkSession, folder: str, set_key: bool = False) -> weekly.Rollups:
    """Roll-ups of the whole fact, which is arranged by its keys; the week key is that of the day or set by the operator."""
    keyed = mapping.with_calendar(mapping.keyed_fact(spark, folder))
    keyed = (weeks.set_week_key(keyed) if set_key else keyed).drop(*mapping.OF_DAY)
    return weekly.Rollups(
        mapping.named(spark, folder, keyed),
        mapping.ref_genre_tg_mkt(spark, folder),
        mapping.ref_ch_group_tg_mkt(spark, folder),
        names_follow_keys=True,
        arranged=lambda: mapping.named(spark, folder, sinks.arranged(keyed)),
    )


def _written(
    spark: SparkSession, folder: str, names: Sequence[str] = weekly.WEEKLY_TABLES, set_key: bool = False
) -> weekly.TableRollups:
    built = _weekly(spark, folder, set_key)
    return weekly.write_tables(built, sinks.scratch_database(spark, "weekly"), names)


def _rebuilt(spark: SparkSession, folder: str, names: Sequence[str]) -> weekly.TableRollups:
    """Write tables, repair the year ends of the fact, rebuild only the weeks concerned."""
    written = _written(spark, folder, names, set_key=True)
    repaired = weeks.repair_year_end(written.fact, REPAIRED_WEEKS)
    return weekly.rebuild_weeks(
        written, repaired, weeks.repaired_weeks(REPAIRED_WEEKS), names, names_follow_keys=True
    )


@register
def incremental_week_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_rebuilt(spark, folder, ["program"]).program, *METRICS)


@register
def incremental_base_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    return _doubles(_rebuilt(spark, folder, _GENRE_TABLES).genre_base, *METRICS)


def _stacked(tables: weekly.Rollups, names: Sequence[str]) -> DataFrame:
    """The rows of several tables below each other, with the table's name; columns a table lacks are null."""
    frames = [getattr(tables, name).withColumn("name", F.lit(name)) for name in names]
    return _doubles(reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), frames), *METRICS)


@register
def incremental_table_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The show roll-up and the show and channel base tables after a rebuild of the repaired weeks."""
    rebuilt = _rebuilt(spark, folder, ["program", "genre_channel", "show", "show_base", "channel_base"])
    return _stacked(rebuilt, ["show", "show_base", "channel_base"])


@register
def weekly_contents(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all tables that the weekly build writes."""
    return _stacked(_written(spark, folder), weekly.WEEKLY_TABLES)


@register
def weekly_build(spark: SparkSession, folder: str) -> DataFrame:
    """Write all tables and count their rows."""
    written = _written(spark, folder)
    counts = [
        getattr(written, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        for name in weekly.WEEKLY_TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def _published(spark: SparkSession, folder: str) -> weekly.PublishedRollups:
    built = _weekly(spark, folder, set_key=True)
    return weekly.publish_tables(built, Builds(spark, scratch_path(spark, "builds")))


def _by_table_and_week(tables: weekly.Rollups) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(metric).alias(metric) for metric in METRICS]]
    frames = [
        getattr(tables, name).groupBy(F.lit(name).alias("name"), "WEEK_KEY").agg(*sums) for name in weekly.WEEKLY_TABLES
    ]
    return _doubles(reduce(DataFrame.unionByName, frames), *METRICS)


@register
def published_builds(spark: SparkSession, folder: str) -> DataFrame:
    """All tables before and after a rebuild of the repaired weeks, both builds read after the second was published."""
    before = _published(spark, folder)
    repaired = weeks.repair_year_end(before.fact, REPAIRED_WEEKS)
    after = weekly.publish_weeks(before, repaired, weeks.repaired_weeks(REPAIRED_WEEKS), names_follow_keys=True)
    both = [_by_table_and_week(tables).withColumn("build", F.lit(tables.number)) for tables in (before, after)]
    return both[0].unionByName(both[1])


@register
def published_retention(spark: SparkSession, folder: str) -> DataFrame:
    """What all tables keep after the old weeks were dropped by metadata."""
    return _by_table_and_week(weekly.publish_retention(_published(spark, folder)))


@register
def published_newest_week(spark: SparkSession, folder: str) -> DataFrame:
    """The newest week of a published table and what is offered by default for it, from the list of the build."""
    builds = _published(spark, folder).builds
    return weeks.default_selection(builds.newest_week("program").withColumnRenamed("max_week", "WEEK_KEY"))


@register
def enriched_genre_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The genre request on written tables, where the week range prunes partitions."""
    written = _written(spark, folder, _GENRE_TABLES)
    return _rounded(dashboard.enriched(written, SELECTION, affinity.GENRE), *_SHARES)


@register
def enriched_channel_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    names = ("program", "genre_channel", "channel_base")
    written = _written(spark, folder, names)
    return _rounded(dashboard.enriched(written, SELECTION, affinity.CHANNEL), *_SHARES)


@register
def enriched_show_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The show level reads the advertiser's rows from the fact itself."""
    names = ("program", "genre_channel", "show", "show_base")
    written = _written(spark, folder, names)
    return _rounded(present.top_rows(dashboard.enriched(written, SELECTION, affinity.SHOW)), *_SHARES)


# --- lists, lookups, parameters ---


@register
def dates_as_text(spark: SparkSession, folder: str) -> DataFrame:
    return files.as_text(mapping.dim_date(spark, folder))


@register
def client_list(spark: SparkSession, folder: str) -> DataFrame:
    return params.names_with_keys(
        mapping.advertisers(spark, folder), "ADVERTISERS_GROUP_KEY", "ADVERTISERS_GROUP_DISPLAY_NAME"
    )


@register
def client_list_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return params.names_with_keys(
        mapping.fact_cust_rev_agg_dly(spark, folder), "ADVERTISERS_GROUP_KEY", "ADVERTISERS_GROUP_DISPLAY_NAME"
    )


@register
def client_list_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The precomputed client table where there is one, else the aggregate."""
    fallback = client_list(spark, folder)
    missing = files.table_or(spark, "client_table_that_is_not_there", fallback)
    database = sinks.scratch_database(spark, "clients")
    sinks.replace_table(fallback, f"{database}.clients")
    present_table = files.table_or(spark, f"{database}.clients", fallback.limit(0))
    return missing.withColumn("origin", F.lit("aggregate")).unionByName(
        present_table.withColumn("origin", F.lit("table"))
    )


@register
def genre_list(spark: SparkSession, folder: str) -> DataFrame:
    return params.names_with_keys(mapping.ref_genre_tg_mkt(spark, folder), "GENRE_KEY", "GENRE_DISPLAY_NAME")


@register
def genre_pick_list(spark: SparkSession, folder: str) -> DataFrame:
    return params.first_keys(mapping.ref_genre_tg_mkt(spark, folder), "GENRE_KEY", "GENRE_NAME").orderBy("name")


@register
def program_first_keys(spark: SparkSession, folder: str) -> DataFrame:
    return params.first_keys(mapping.fact(spark, folder), "PROGRAM_GROUP_KEY", "PROGRAM_GROUP_DISPLAY_NAME")


@register
def cell_pick_list(spark: SparkSession, folder: str) -> DataFrame:
    cells = mapping.ref_tg_mkt(spark, folder).withColumn("cell_key", text.pair_key(F.col("TG_KEY"), F.col("MARKET_KEY")))
    return cells.orderBy("TG_MARKET_DISPLAY_NAME")


@register
def cells_of_source(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.ref_tg_mkt(spark, folder).where(F.col("SOURCE") == SOURCE_NEWER)


def _chosen_names(spark: SparkSession, folder: str) -> DataFrame:
    nations = mapping.table(spark, folder, "nation").select(F.col("n_name").alias("name"))
    return nations.unionByName(mapping.table(spark, folder, "supplier").select(F.col("s_name").alias("name")))


@register
def name_to_keys(spark: SparkSession, folder: str) -> DataFrame:
    return params.to_keys(_chosen_names(spark, folder), client_list(spark, folder))


@register
def cell_name_to_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the base cells' texts, and of two that do not exist."""
    reference = mapping.ref_ch_group_tg_mkt(spark, folder)
    chosen = reference.select(F.col("TG_MARKET_DISPLAY_NAME").alias("name"))
    missing = chosen.select(F.concat("name", F.lit("?")).alias("name"))
    return params.to_cells(chosen.unionByName(missing).distinct(), mapping.ref_tg_mkt(spark, folder))


@register
def validate_params(spark: SparkSession, folder: str) -> DataFrame:
    chosen = _chosen_names(spark, folder).withColumn("parameter", F.lit("client"))
    domain = client_list(spark, folder).withColumn("parameter", F.lit("client"))
    return params.unknown(chosen, domain)


# --- files ---


@register
def network_colors_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "colors")
    sinks.write_csv(mapping.network_colors(spark, folder), path)
    return files.network_colors(spark, path)


@register
def reference_cells_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "reference")
    sinks.write_csv(mapping.ref_ch_group_tg_mkt(spark, folder), path)
    return files.reference_cells(spark, path, "TG 1")


@register
def search_terms_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "terms")
    sinks.write_csv(mapping.table(spark, folder, "nation").select("n_name"), path, header=False)
    return files.search_terms(spark, path)


@register
def news_csv_append(spark: SparkSession, folder: str) -> DataFrame:
    """Append all items twice to a header-less file and read it back."""
    path = scratch_path(spark, "news")
    rows = files.as_text(mapping.news(spark, folder).select(*NEWS_KEY))
    sinks.append_csv(rows, path)
    sinks.append_csv(rows, path)
    return files.news_items(spark, path)


def _planted(spark: SparkSession, path: str, lines: DataFrame) -> None:
    """Add raw lines to CSV files that are there."""
    lines.write.mode("append").text(path)


@register
def checked_reference_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A reference file with faulty lines among its rows: what is used, and what is set aside with the reason."""
    path = scratch_path(spark, "reference")
    good = mapping.ref_ch_group_tg_mkt(spark, folder)
    sinks.write_csv(good, path, header=False)
    name = F.regexp_replace("n_name", "[^A-Za-z]", "_")
    _planted(spark, path, mapping.table(spark, folder, "nation").select(F.concat(name, F.lit(",three,fields")).alias("value")))
    numbers = mapping.table(spark, folder, "supplier").where("s_suppkey % 3 = 0").select(
        F.concat_ws(",", F.col("s_suppkey").cast("string"), F.lit("c"), F.lit("one"), F.lit("1,S,a,b,ab")).alias("value")
    )
    _planted(spark, path, numbers)
    unnamed = mapping.table(spark, folder, "supplier").where("s_suppkey % 3 = 1").select(
        F.concat(F.lit(","), F.col("s_suppkey").cast("string"), F.lit(",1,1,S,a,b,ab")).alias("value")
    )
    _planted(spark, path, unnamed)
    checked = files.checked_csv(spark, path, REF_CH_GROUP_TG_MKT, ("CHANNEL_GROUP_KEY", "TG_KEY", "MARKET_KEY"), header=False)
    used = checked.good.select(F.to_csv(F.struct("CHANNEL_GROUP_KEY", "TG_KEY", "MARKET_KEY")).alias("record"))
    return checked.rejects.select("record", "reason").unionByName(used.withColumn("reason", F.lit("none")))


@register
def checked_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Items of feeds, some of which are cut off, have no item, or items without date or link, with what was rejected."""
    page = F.col("page_id")
    day = F.when(page % 5 == 0, "some day").otherwise(F.date_format("PublishDate", "EEE, dd MMM yyyy HH:mm:ss' GMT'"))
    link = F.when(page % 5 == 1, "http://feed.example/").otherwise(F.concat(F.lit("http://feed.example/url="), page.cast("string")))
    item = F.concat(
        F.lit("<item><title>t</title><link>"), link, F.lit("</link><pubDate>"), day, F.lit("</pubDate><description>d</description></item>")
    )
    body = F.when(page % 7 == 0, F.lit("")).otherwise(item)
    document = F.concat(F.lit("<rss><channel>"), body, F.when(page % 11 == 0, "").otherwise("</channel></rss>"))
    feeds = mapping.news(spark, folder).select(page.cast("string").alias("SearchTerm"), page.alias("feed_no"), document.alias("document"))
    checked = news.checked_items(feeds)
    used = checked.good.select("feed_no", F.lit("none").alias("reason"), "position")
    return used.unionByName(checked.rejects.select("feed_no", "reason", "position"))


# --- hierarchy, scope, entitlements ---

# Example: views of one's own, of the team and of the market are given to ever more groups, and group g sees the
# report of every g-th region.
_VIEWS = ("market_view", "team_view", "own_view")
ENTITLEMENTS = scope.Entitlements(
    groups={
        f"Group {group}": (*_VIEWS[: 4 - group], *[f"region_{region}" for region in range(5) if region % group == 0])
        for group in range(1, 5)
    },
    executive_view="own_view",
    manager_view="team_view",
    home_view="market_view",
)


@register
def reportee_closure(spark: SparkSession, folder: str) -> DataFrame:
    return scope.reportees(mapping.ref_employee_hierarchy(spark, folder), mapping.ref_employee_access(spark, folder))


@register
def channel_closure(spark: SparkSession, folder: str) -> DataFrame:
    return scope.channels_below(mapping.ref_employee_hierarchy(spark, folder), mapping.ref_employee_access(spark, folder))


@register
def channel_lists(spark: SparkSession, folder: str) -> DataFrame:
    return scope.key_lists(channel_closure(spark, folder), "manager", "CHANNEL_GROUP_KEY", most=6)


@register
def row_scope(spark: SparkSession, folder: str) -> DataFrame:
    return scope.row_scope(mapping.ref_employee_hierarchy(spark, folder), reportee_closure(spark, folder))


@register
def row_scope_reportees(spark: SparkSession, folder: str) -> DataFrame:
    """The scope of the market-share report: reportees without the user."""
    return scope.row_scope(
        mapping.ref_employee_hierarchy(spark, folder), reportee_closure(spark, folder), include_self=False
    )


@register
def rows_in_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Real channels that employee 1 sees, and what the top employee sees."""
    access = mapping.ref_employee_access(spark, folder)
    scopes = materialize(row_scope(spark, folder), "scope")
    seen = [
        scope.without_everything(scope.rows_in_scope(access, scopes, user)).withColumn("user", F.lit(user))
        for user in ("U1", "U0")
    ]
    return seen[0].unionByName(seen[1])


@register
def scope_key_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Employee and location key texts of the market-share report of employee 1."""
    access = mapping.ref_employee_access(spark, folder)
    seen = scope.rows_in_scope(access, row_scope_reportees(spark, folder), "U1")
    employees = scope.key_lists(seen.withColumn("kind", F.lit("employees")), "kind", "EMPLOYEE_KEY")
    locations = scope.key_lists(seen.withColumn("kind", F.lit("locations")), "kind", "LOCATION_KEY")
    return employees.unionByName(locations)


@register
def channel_key_texts(spark: SparkSession, folder: str) -> DataFrame:
    access = scope.without_everything(mapping.ref_employee_access(spark, folder))
    return scope.key_lists(access, "CHANNEL_GROUP_DISPLAY_NAME", "CHANNEL_GROUP_KEY")


@register
def may_see_all(spark: SparkSession, folder: str) -> DataFrame:
    return scope.may_see_all(mapping.ref_employee_hierarchy(spark, folder), mapping.ref_employee_access(spark, folder))


@register
def employee_roles(spark: SparkSession, folder: str) -> DataFrame:
    return scope.roles_of(mapping.ref_employee_hierarchy(spark, folder))


@register
def entitlement_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return scope.entitlement_matrix(mapping.ref_employee_hierarchy(spark, folder), ENTITLEMENTS)


@register
def entitlement_removal(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix without the dashboard that executives lose."""
    hierarchy = mapping.ref_employee_hierarchy(spark, folder)
    executives = hierarchy.where(F.col("EMPLOYEE_ROLE") == scope.EXECUTIVE_ROLE)
    removals = executives.select("EMPLOYEE_NT_ID", F.lit("region_0").alias("dashboard"))
    return scope.remove_entitlement(scope.entitlement_matrix(hierarchy, ENTITLEMENTS), removals)


# --- news ---

# The moment of a news request is a parameter.
NEWS_NOW = "2024-01-08 00:00:00"


def _now() -> Column:
    return F.lit(NEWS_NOW).cast("timestamp_ntz")


def _news_text(df: DataFrame) -> DataFrame:
    return df.withColumn("PublishDate", F.date_format("PublishDate", "yyyy-MM-dd HH:mm:ss"))


def _archive(spark: SparkSession, folder: str) -> str:
    """An archive that got every item twice, in two runs."""
    table = f"{sinks.scratch_database(spark, 'news')}.archive"
    news.create_archive(spark, table)
    rows = mapping.news(spark, folder).select(*NEWS_KEY)
    news.archive_items(rows.unionByName(rows), table)
    news.archive_items(rows, table)
    return table


@register
def news_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _news_text(news.items(mapping.feeds(spark, folder)))


@register
def news_top10(spark: SparkSession, folder: str) -> DataFrame:
    return _news_text(news.first_items(news.items(mapping.feeds(spark, folder))))


@register
def news_distinct(spark: SparkSession, folder: str) -> DataFrame:
    rows = mapping.news(spark, folder).select(*NEWS_KEY)
    return _news_text(news.deduplicated(rows.unionByName(rows)))


@register
def news_archive_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return _news_text(spark.table(_archive(spark, folder)).select(*NEWS_KEY))


@register
def news_visible(spark: SparkSession, folder: str) -> DataFrame:
    archive = mapping.news(spark, folder).select(*NEWS_KEY)
    hosts = ("www.example.com", "THTHRE.example.com", "m.ththth.example.net")
    return _news_text(news.visible(archive, _now(), hosts, days=3))


@register
def news_fresh_counts(spark: SparkSession, folder: str) -> DataFrame:
    return news.fresh_counts(mapping.news(spark, folder), _now(), days=3)


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of the items, and the nation names, for which there is no news."""
    found = mapping.news(spark, folder).select(F.col("SearchTerm").alias("term")).distinct()
    return found.unionByName(mapping.table(spark, folder, "nation").select(F.col("n_name").alias("term")))


@register
def news_terms_to_fetch(spark: SparkSession, folder: str) -> DataFrame:
    return news.terms_to_fetch(_terms(spark, folder), mapping.news(spark, folder), _now())


@register
def news_ticker(spark: SparkSession, folder: str) -> DataFrame:
    return news.ticker(mapping.news(spark, folder), _terms(spark, folder), _now(), ("m.ththth.example.net",))


@register
def news_ticker_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Choices in mixed case, one per search term, that the mapping leads back to it, and nations without news."""
    archive = mapping.news(spark, folder)
    found = archive.select("SearchTerm").where(F.col("SearchTerm") != "").distinct()
    choice = F.concat(F.upper("SearchTerm"), F.lit("'s & Co"))
    chosen = found.select(choice.alias("term")).unionByName(
        mapping.table(spark, folder, "nation").select(F.initcap("n_name").alias("term"))
    )
    table = found.select(
        F.lit(1).alias("ordinal"),
        F.concat(F.lower("SearchTerm"), F.lit("s%20%26%20co")).alias("searchterm"),
        F.col("SearchTerm").alias("to_be_searched"),
    )
    return news.ticker_of_choices(archive, chosen, table, _now())


@register
def term_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Product names as search terms; each has two mapping rows, the first one counts."""
    parts = mapping.table(spark, folder, "part")
    chosen = parts.select(F.concat(F.upper("p_name"), F.lit("'s & \"Co\"/"), F.col("p_type")).alias("term"))
    sizes = parts.groupBy("p_name").agg(F.min("p_size").alias("size"), F.max("p_size").alias("largest"))
    encoded = F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("s%20%26%20co/economy"))
    first = sizes.select(
        F.lit(1).alias("ordinal"), encoded.alias("searchterm"), F.concat_ws(" ", "p_name", "size").alias("to_be_searched")
    )
    second = sizes.select(
        F.lit(2).alias("ordinal"), encoded.alias("searchterm"), F.concat_ws(" ", "p_name", "largest").alias("to_be_searched")
    )
    return news.mapped_terms(chosen.distinct(), second.unionByName(first))


@register
def news_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Term and name clean-up on titles and sources."""
    rows = mapping.news(spark, folder)
    return rows.select(
        "page_id",
        news_functions.compact_term(F.col("Title")).alias("compact"),
        text.ascii_only(F.col("Title")).alias("ascii"),
        text.slug(F.col("Title")).alias("slug"),
        text.spell_ampersand(F.col("Title")).alias("spelled"),
    )


@register
def news_stream_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Feed files read as a stream, twice, into one archive."""
    path = scratch_path(spark, "feeds")
    mapping.feeds(spark, folder).write.parquet(path)
    table = f"{sinks.scratch_database(spark, 'stream')}.archive"
    news.create_archive(spark, table)
    for _ in range(2):
        checkpoint = scratch_path(spark, "stream-state")
        news_archive.start(spark, path, table, checkpoint).awaitTermination()
    return _news_text(spark.table(table).select(*NEWS_KEY))


@register
def news_stream_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Items by day: those in the archive, and how many rows the stream had to compare with it.

    Every third feed arrives in a first run. The second run goes on from its checkpoint with all feeds, a file at a time, and then
    with all of them again: repeats of the first run, repeats within the run, and items published long before others
    that arrived earlier. Repeats are told by the state, so each item is compared once.
    """
    path, checkpoint = scratch_path(spark, "feeds"), scratch_path(spark, "stream-state")
    database = sinks.scratch_database(spark, "stream")
    table, log = f"{database}.archive", f"{database}.tested"
    news.create_archive(spark, table)
    spark.sql(f"CREATE TABLE {log} (day date, batch bigint) USING parquet")

    def tested(batch: DataFrame, number: int) -> None:
        batch.select(F.to_date("PublishDate").alias("day"), F.lit(number).cast("long")).write.insertInto(log)

    feeds = materialize(mapping.feeds(spark, folder), "all-feeds")
    third = F.crc32(F.encode("SearchTerm", "UTF-8")) % 3 == 0
    for arriving in ([feeds.where(third)], [feeds, feeds]):
        for part in arriving:
            part.coalesce(2).write.mode("append").parquet(path)
        news_archive.start(spark, path, table, checkpoint, files_per_batch=1, tested=tested).awaitTermination()
    archived = spark.table(table).groupBy(F.to_date("PublishDate").alias("day")).agg(F.count(F.lit(1)).alias("archived"))
    return archived.join(spark.table(log).groupBy("day").agg(F.count(F.lit(1)).alias("tested")), "day", "full")
