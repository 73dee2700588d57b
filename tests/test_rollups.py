from decimal import Decimal

from helpers import fact, rows

from reachlens.operators import rollups, weeks
from reachlens.plans import weekly
from reachlens.schemas import REF_CH_GROUP_TG_MKT, REF_GENRE_TG_MKT
from reachlens.sources import mapping, sinks


def channel_reference(spark, *cells):
    return spark.createDataFrame([(k, f"c{k}", t, m, "CUST_SALES", "", "", "") for k, t, m in cells], REF_CH_GROUP_TG_MKT)


def genre_reference(spark, *cells):
    return spark.createDataFrame([(k, f"G{k}", f"g{k}", t, m, "CUST_SALES", "") for k, t, m in cells], REF_GENRE_TG_MKT)


def test_one_name_per_key(spark):
    """A key with two names stays one row, with the greatest name."""
    dirty = fact(
        spark,
        {"GENRE_DISPLAY_NAME": "News", "ADGRP": 2},
        {"GENRE_DISPLAY_NAME": "NEWS", "ADGRP": 3},
        {"GENRE_KEY": 2, "ADGRP": None, "FCT": None, "TVT": None},
    )
    found = rollups.program_rollup(dirty)
    assert rows(found, "GENRE_KEY", "GENRE_DISPLAY_NAME", "ADGRP") == [
        (1, "News", Decimal(5)),
        (2, "genre 2", None),
    ]


def test_name_shortcut_changes_nothing_for_clean_names(spark, small):
    clean = mapping.fact(spark, small)
    for build in (rollups.program_rollup, rollups.show_rollup):
        full, short = build(clean), build(clean, names_follow_keys=True)
        assert full.exceptAll(short).isEmpty()
        assert short.exceptAll(full).isEmpty()


def test_duplicated_reference_rows_multiply_unless_guarded(spark):
    show = rollups.show_rollup(fact(spark, {"ADGRP": 2}, {"TG_KEY": 2, "ADGRP": 5}))
    reference = channel_reference(spark, (1, 1, 1), (1, 1, 1))
    assert rows(rollups.show_base(show, reference), "ADGRP") == [(Decimal(2),), (Decimal(2),)]
    assert rows(rollups.show_base(show, reference, unique_reference=True), "ADGRP") == [(Decimal(2),)]


def test_genre_base_takes_the_base_cell_only(spark):
    data = fact(spark, {"ADGRP": 2}, {"CHANNEL_GROUP_KEY": 2, "ADGRP": 4}, {"MARKET_KEY": 2, "ADGRP": 8})
    genre_channel = rollups.genre_channel_rollup(rollups.program_rollup(data))
    base = rollups.genre_base(genre_channel, genre_reference(spark, (1, 1, 1)))
    assert rows(base, "GENRE_KEY", "NETWORK_KEY", "ADGRP") == [(1, 1, Decimal(6))]


def test_rebuilding_weeks_equals_building_all(spark):
    """A repair empties one week and fills another; the tables follow without a full build."""
    data = fact(
        spark,
        {"WEEK_KEY": 201552, "MONTH": "JAN", "CALENDAR_YEAR": 2015, "ADGRP": 1},
        {"WEEK_KEY": 201552, "MONTH": "DEC", "CALENDAR_YEAR": 2015, "ADGRP": 2},
        {"WEEK_KEY": 201652, "MONTH": "JAN", "CALENDAR_YEAR": 2016, "ADGRP": 4},
        {"WEEK_KEY": 201510, "ADGRP": 8},
        {"WEEK_KEY": 201452, "MONTH": "DEC", "CALENDAR_YEAR": 2014, "ADGRP": 16},
    )
    references = genre_reference(spark, (1, 1, 1)), channel_reference(spark, (1, 1, 1))
    written = weekly.write_tables(weekly.Rollups(data, *references), sinks.scratch_database(spark, "t"))
    listed = [201453, 201552, 201652]
    repaired = weeks.repair_year_end(data, listed)
    rebuilt = weekly.rebuild_weeks(written, repaired, weeks.repaired_weeks(listed))
    full = weekly.Rollups(repaired, *references)
    for name in weekly.WEEKLY_TABLES:
        found, expected = getattr(rebuilt, name), getattr(full, name)
        expected = expected.select(*found.columns)
        assert rows(found, *found.columns) == rows(expected, *found.columns), name
    assert rows(rebuilt.program, "WEEK_KEY", "ADGRP") == [
        (201452, Decimal(17)),
        (201510, Decimal(8)),
        (201552, Decimal(6)),
    ]
    left = {row.partition for row in spark.sql(f"SHOW PARTITIONS {rebuilt.database}.program").collect()}
    assert "WEEK_KEY=201652" not in left


def test_older_year_shift_and_week_key(spark):
    data = fact(
        spark,
        {"MONTH": "JUL", "CALENDAR_YEAR": 2015, "BARC_WEEK": 30},
        {"MONTH": "JAN", "CALENDAR_YEAR": 2015, "BARC_WEEK": 52},
        {"MONTH": "JAN", "CALENDAR_YEAR": 2015, "BARC_WEEK": 2},
    )
    found = weeks.set_week_key(weeks.shift_older_years(data))
    assert rows(found, "WEEK_KEY") == [(201430,), (201452,), (201502,)]


def test_retention_keeps_two_years(spark):
    data = fact(spark, {"WEEK_KEY": 201510}, {"WEEK_KEY": 201310}, {"WEEK_KEY": 201311})
    assert rows(weeks.retain_recent(data), "WEEK_KEY") == [(201311,), (201510,)]


def test_missing_month_is_not_repaired(spark):
    data = fact(spark, {"WEEK_KEY": 201552, "MONTH": None})
    assert rows(weeks.repair_year_end(data, [201552]), "WEEK_KEY") == [(201552,)]
