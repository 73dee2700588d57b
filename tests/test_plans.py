"""What the physical plans must and must not contain."""

import pytest
from helpers import plan_text

from reachlens.operators import affinity, rollups, weeks
from reachlens.plans import queries, weekly
from reachlens.sources import mapping, sinks

LAZY = [
    "prog_rollup",
    "genre_channel_rollup",
    "show_rollup",
    "genre_affinity_base",
    "affinity_show",
    "enriched_channel",
    "week_retention",
    "row_scope",
    "news_top10",
    "news_visible",
    "term_mapping",
    "name_to_keys",
    "entitlement_matrix",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, small, name):
    plan = plan_text(queries.QUERIES[name](spark, small))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan


def test_week_range_reaches_the_scan(spark, small):
    plan = plan_text(mapping.fact(spark, small, (199601, 199652)))
    assert "GreaterThanOrEqual(l_shipdate,1996-01-06" in plan
    assert "LessThan(l_shipdate,1997-01-01" in plan


def test_rollup_reads_no_text_it_does_not_need(spark, small):
    """The program name is not part of the program roll-up, so it is not read."""
    plan = plan_text(rollups.program_rollup(mapping.fact(spark, small), names_follow_keys=True))
    assert "p_name" not in plan
    assert "o_totalprice" not in plan


def test_rollup_with_clean_names_needs_no_sort(spark, small):
    data = mapping.fact(spark, small)
    assert "SortAggregate" not in plan_text(rollups.program_rollup(data, names_follow_keys=True))


def test_equal_tables_are_aggregated_once(spark, small):
    """Genre totals and level totals come from the same frame at the genre level."""
    frames = weekly.Rollups(
        mapping.fact(spark, small), mapping.ref_genre_tg_mkt(spark, small), mapping.ref_ch_group_tg_mkt(spark, small), True
    )
    cells = affinity.cell_totals(frames, queries.SELECTION, affinity.GENRE)
    assert cells.genre is cells.totals
    assert cells.client_genre is cells.client
    show = affinity.cell_totals(frames, queries.SELECTION, affinity.SHOW)
    assert show.genre is not show.totals


def test_week_range_prunes_table_partitions(spark, small):
    frames = weekly.Rollups(
        mapping.fact(spark, small).where("WEEK_KEY between 199605 and 199609"),
        mapping.ref_genre_tg_mkt(spark, small),
        mapping.ref_ch_group_tg_mkt(spark, small),
        True,
    )
    written = weekly.write_tables(frames, sinks.scratch_database(spark, "p"), ["program"])
    assert len(spark.sql(f"SHOW PARTITIONS {written.database}.program").collect()) == 5
    plan = plan_text(written.program.where(queries.SELECTION.in_weeks()))
    assert "PartitionFilters: [isnotnull(WEEK_KEY" in plan


def test_written_roll_ups_come_from_one_arranged_fact(spark, small):
    """The joins of the fact are made once; what is written of it by week needs no shuffle of its own."""
    frames = weekly.Rollups(
        mapping.fact(spark, small).where("WEEK_KEY between 199605 and 199609"),
        mapping.ref_genre_tg_mkt(spark, small),
        mapping.ref_ch_group_tg_mkt(spark, small),
        True,
    )
    written = weekly.write_tables(frames, sinks.scratch_database(spark, "once"), ["program", "genre_channel", "show"])
    assert "Join" not in plan_text(written.fact)
    rows = weekly.Rollups(sinks.arranged(written.fact), frames.genre_reference, frames.channel_reference, True)
    for name in ("program", "genre_channel", "show"):
        assert "Exchange" not in plan_text(sinks.by_week(getattr(rows, name)))
        table = getattr(written, name)
        assert sinks.SLICE not in table.columns
        assert table.exceptAll(getattr(frames, name).select(*table.columns)).isEmpty()
        assert table.count() == getattr(frames, name).count()


def test_fact_is_moved_and_written_without_what_follows_from_its_keys(spark, small):
    """Names of nations, calendar columns and the net price are added to the arranged fact when it is read."""
    fact = queries._published(spark, small).fact
    files = [name for name in fact.inputFiles() if "/arranged/" in name]
    kept = spark.read.parquet(*files).columns
    assert {"NETWORK_KEY", "ADVERTISERS_GROUP_KEY", sinks.WEEK} <= {*kept}
    assert not {"NETWORK_DISPLAY_NAME", "ADVERTISERS_GROUP_DISPLAY_NAME", "TVT", "CALENDAR_YEAR", "BARC_WEEK", "MONTH"} & {*kept}
    whole = weeks.set_week_key(mapping.fact(spark, small))
    assert fact.columns == whole.columns and fact.count() == whole.count()
    assert fact.exceptAll(whole).isEmpty()


def test_roll_ups_of_the_keyed_fact_need_no_shuffle(spark, small):
    """The joins that add the names of nations leave the arranged rows where they are."""
    built = queries._weekly(spark, small)
    rows = weekly.Rollups(built.arranged(), built.genre_reference, built.channel_reference, True)
    for name in weekly.LARGE_TABLES:
        plan = plan_text(sinks.by_week(getattr(rows, name)))
        assert "Exchange" not in plan.replace("BroadcastExchange", ""), name


def test_show_top_rows_take_no_full_sort(spark, small):
    assert "TakeOrderedAndProject" in plan_text(queries.QUERIES["enriched_show_top100"](spark, small))


def test_chosen_cells_reach_the_scans(spark, small):
    """The cell test of a request stands below the joins, on the line and on the order side."""
    fact = mapping.fact(spark, small, queries.SELECTION.weeks)
    plan = plan_text(affinity.sums_of_request(fact, queries.SELECTION, affinity.GENRE))
    below = plan[plan.index("Join") :]
    assert "array_position" in below and "l_returnflag" in below
    for scanned, test in (("l_returnflag", "array_position([A,N,R]"), ("o_orderpriority", "substring(o_orderpriority")):
        filters = [line for line in plan.splitlines() if "Filter" in line and test in line]
        assert filters, scanned
    assert "genre_base" not in plan and "p_name" not in plan


def test_base_cells_are_tested_before_the_other_dimensions(spark, small):
    """The reference is joined deeper in the plan than customers and nations."""
    cells = mapping.ref_ch_group_tg_mkt(spark, small)
    plan = plan_text(mapping.fact(spark, small, queries.SELECTION.weeks, base_cells=cells))
    depth = {line.strip().split("parquet ")[-1]: len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if "FileScan" in line}
    lines = plan.splitlines()

    def deepest(name):
        return max(len(line) - len(line.lstrip(" :+-")) for line in lines if "FileScan" in line and name in line)

    assert depth and deepest("l_returnflag") > deepest("c_custkey")


@pytest.mark.parametrize("name", ["client_list", "client_list_revenue"])
def test_name_lists_do_not_sort_the_fact(spark, small, name):
    """Only the pairs that are left after a hash aggregation are sorted for the text maximum."""
    plan = plan_text(queries.QUERIES[name](spark, small))
    assert "HashAggregate" in plan
    scan = plan.index("FileScan")
    assert plan.rindex("SortAggregate") < plan.index("HashAggregate") < scan


@pytest.mark.parametrize(
    "name", ["max_week", "default_end_date", "end_date_per_week", "week_repair", "week_shift_older", "week_retention"]
)
def test_week_queries_scan_one_table(spark, small, name):
    plan = plan_text(queries.QUERIES[name](spark, small))
    assert "l_shipdate" in plan and "Join" not in plan
    assert all(column not in plan for column in ("o_orderkey", "p_partkey", "s_suppkey", "c_custkey"))


def test_exploration_reads_one_cell_from_its_year_on(spark, small):
    plan = plan_text(queries.QUERIES["exploration_all"](spark, small))
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01" in plan
    assert plan.count("o_orderpriority") and "TG_DISPLAY_NAME" not in plan


def test_genres_are_not_collected(spark, small):
    assert "collect_set" not in plan_text(mapping.fact(spark, small))


def test_archive_is_pruned_by_literal_days(spark, small):
    import datetime as dt

    from reachlens.operators import news

    table = f"{sinks.scratch_database(spark, 'pruned')}.archive"
    news.create_archive(spark, table)
    news.archive_items(mapping.news(spark, small), table)
    days = sinks.between(spark.table(table), news.ARCHIVE_DAY, dt.date(2024, 1, 1), dt.date(2024, 1, 1))
    plan = plan_text(days)
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "2024-01-01" in filters or "19723" in filters
    assert 0 < days.count() < spark.table(table).count()


def test_archive_is_pruned_to_the_days_of_the_new_items(spark):
    """Two days a year apart: nothing between them is read."""
    import datetime as dt

    from reachlens.operators import news
    from reachlens.schemas import ARCHIVE_DAY, NEWS

    table = f"{sinks.scratch_database(spark, 'days')}.archive"
    news.create_archive(spark, table)
    days = [dt.datetime(2014, 1, 1) + dt.timedelta(days=30 * n) for n in range(13)]
    rows = spark.createDataFrame([(f"t{d}", d, "l", "s", "x") for d in days], NEWS)
    news.archive_items(rows, table)
    late = spark.createDataFrame([(days[0].date(),), (days[-1].date(),), (None,)], f"{ARCHIVE_DAY} date")
    found = sinks.in_partitions_of(spark.table(table), late, ARCHIVE_DAY)
    assert len(found.inputFiles()) == 2 and found.count() == 2
    plan = plan_text(found)
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert f"{ARCHIVE_DAY}" in filters and " IN " in filters and "2014-01-31" not in filters
    assert sinks.in_partitions_of(spark.table(table), late, ARCHIVE_DAY, most=1).count() == 13
    assert sinks.in_partitions_of(spark.table(table), late.limit(0), ARCHIVE_DAY) is None


def test_client_list_joins_names_to_keys_only(spark, small):
    """Advertisers are found by key; no name and no metric of the fact is read, and parts and channels only tell rows apart."""
    plan = plan_text(queries.QUERIES["client_list"](spark, small))
    for unwanted in ("l_quantity", "l_shipdate", "l_returnflag", "p_name", "s_name", "o_orderpriority"):
        assert unwanted not in plan
    assert plan.count("LeftSemi") == 3


def test_latest_dates_come_from_footers(spark, small):
    plan = plan_text(queries.QUERIES["latest_dates_from_footers"](spark, small))
    assert plan.count("MAX(PRG_DATE)") >= 2 and "PushedAggregation: [MAX(PRG_DATE)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
