import pytest
from helpers import fact, rows

from reachlens.operators import affinity, present
from reachlens.plans import dashboard, weekly
from reachlens.schemas import REF_CH_GROUP_TG_MKT, REF_GENRE_TG_MKT
from reachlens.sources import mapping

SELECTION = affinity.Selection(1, "ADGRP", affinity.Cell(1, 1), affinity.Cell(11, 1), 201501, 201552)


def tables(spark, *data, genre_cells=((1, 1, 1),), channel_cells=((1, 1, 1),), kind=weekly.Rollups):
    genres = [(k, f"G{k}", f"genre {k}", t, m, "CUST_SALES", "") for k, t, m in genre_cells]
    channels = [(k, f"c{k}", t, m, "CUST_SALES", "", "", "") for k, t, m in channel_cells]
    return kind(
        fact(spark, *data),
        spark.createDataFrame(genres, REF_GENRE_TG_MKT),
        spark.createDataFrame(channels, REF_CH_GROUP_TG_MKT),
    )


def totals(frames, selection=SELECTION, level=affinity.GENRE):
    return affinity.tg_affinity(frames.cells(selection, level))


def test_equal_values_of_two_cells_count_once(spark):
    frames = tables(
        spark,
        {"TG_KEY": 1, "ADGRP": 5},
        {"TG_KEY": 11, "ADGRP": 5},
        {"TG_KEY": 1, "NETWORK_KEY": 2, "ADGRP": 2},
        {"TG_KEY": 11, "NETWORK_KEY": 2, "ADGRP": 3},
    )
    found = rows(totals(frames), "level", "prog_metric", "metric_share", "client_metric", "client_share")
    # The genre totals differ between the cells (7 and 8), so both count there.
    assert [tuple(map(str, row)) for row in found] == [
        ("network 1", "5.0000000", "15.0000000", "5.0000000", "15.0000000"),
        ("network 2", "5.0000000", "15.0000000", "5.0000000", "15.0000000"),
    ]


def test_same_cell_twice_counts_once(spark):
    frames = tables(spark, {"ADGRP": 5}, {"ADGRP": 6})
    twice = affinity.Selection(1, "ADGRP", affinity.Cell(1, 1), affinity.Cell(1, 1), 201501, 201552)
    assert [float(row.prog_metric) for row in totals(frames, twice).collect()] == [11.0]


def test_missing_advertiser_values_stay_missing(spark):
    frames = tables(spark, {"ADGRP": 5}, {"NETWORK_KEY": 2, "ADVERTISERS_GROUP_KEY": 9, "ADGRP": 4})
    assert rows(totals(frames), "level", "client_metric")[1] == ("network 2", None)


def test_zero_denominator_gives_no_affinity(spark):
    frames = tables(spark, {"TG_KEY": 11, "ADGRP": 5}, {"TG_KEY": 1, "ADGRP": 0})
    (row,) = dashboard.enriched(frames, SELECTION, affinity.GENRE).collect()
    assert row.affinity is None
    assert row.genre_share == 100.0


def test_advertiser_without_spend_gives_an_empty_frame(spark):
    frames = tables(spark, {"ADGRP": 0}, {"ADVERTISERS_GROUP_KEY": 2, "ADGRP": 4})
    assert dashboard.enriched(frames, SELECTION, affinity.GENRE).isEmpty()


def test_negative_total_gives_no_share_of_total(spark):
    frames = tables(spark, {"ADGRP": -4}, {"ADVERTISERS_GROUP_KEY": 2, "ADGRP": 10})
    (row,) = dashboard.enriched(frames, SELECTION, affinity.GENRE).collect()
    assert row.overall_share is None


def test_rows_without_a_name_are_left_out(spark):
    frames = tables(spark, {"ADGRP": 5}, {"NETWORK_KEY": 2, "NETWORK_DISPLAY_NAME": None, "ADGRP": 5})
    (row,) = dashboard.enriched(frames, SELECTION, affinity.GENRE).collect()
    assert (row.level, row.overall_share) == ("network 1", 100.0)


def test_names_are_cleaned_after_aggregation(spark):
    frames = tables(spark, {"NETWORK_DISPLAY_NAME": "Café", "ADGRP": 5})
    (row,) = dashboard.enriched(frames, SELECTION, affinity.GENRE).collect()
    assert row.level == "Caf"


def test_show_level_carries_crossed_keys(spark):
    frames = tables(spark, {"CHANNEL_GROUP_KEY": 7, "PROGRAM_GROUP_KEY": 8, "ADGRP": 5})
    (row,) = totals(frames, level=affinity.SHOW).collect()
    assert (row.category, row.cat_key, row.level, row.level_key) == ("program_group 8", 7, "channel_group 7", 8)


def test_unknown_metric_is_refused():
    with pytest.raises(ValueError):
        affinity.Selection(1, "ADGRP; drop", affinity.Cell(1, 1), affinity.Cell(1, 1), 1, 2)


@pytest.mark.parametrize("level", affinity.LEVELS.values(), ids=affinity.LEVELS.keys())
def test_rollups_and_fact_give_the_same_request(spark, small, level):
    from reachlens.plans.queries import SELECTION as chosen

    parts = mapping.fact(spark, small), mapping.ref_genre_tg_mkt(spark, small), mapping.ref_ch_group_tg_mkt(spark, small)
    through_rollups = dashboard.enriched(weekly.Rollups(*parts), chosen, level)
    from_fact = dashboard.enriched(weekly.FactOnly(*parts), chosen, level)
    names = through_rollups.columns
    assert rows(through_rollups, *names) == rows(from_fact, *names)


def test_genre_invariants(spark, small):
    """At the genre level names repeat in category and genre, keys are unique, and rows add up to the genre."""
    from reachlens.plans.queries import affinity_genre

    found = affinity_genre(spark, small).collect()
    assert all(row.category == row.genre and row.level == row.ntwk for row in found)
    assert len({(row.cat_key, row.level_key) for row in found}) == len(found)
    sums = {}
    for row in found:
        sums[row.genre] = sums.get(row.genre, 0) + row.prog_metric
    assert all(abs(sums[row.genre] - row.metric_share) < 1e-6 for row in found)


def test_share_of_total_has_one_base(spark, small):
    from reachlens.plans.queries import enriched_channel

    found = [row for row in enriched_channel(spark, small).collect() if row.overall_share]
    bases = {round(row.client_metric / row.overall_share * 100, 2) for row in found}
    assert len(bases) == 1
    assert abs(sum(row.overall_share for row in found) - 100) < 1e-4


def test_genre_totals_are_averaged_when_names_merge(spark):
    data = spark.createDataFrame(
        [("p", "c", 10.0, 40.0, 1.0, 8.0, "g", "n"), ("p", "c", 20.0, 40.0, None, 8.0, "g", "n")],
        "category string, level string, prog_metric double, metric_share double, client_metric double,"
        " client_share double, genre string, ntwk string",
    )
    (row,) = affinity.by_name(data).collect()
    assert (row.prog_metric, row.metric_share, row.client_metric, row.client_share) == (30.0, 40.0, 1.0, 8.0)


def test_upper_name_lookup_without_reference_has_no_base(spark):
    frames = tables(spark, {"ADGRP": 5}, {"GENRE_KEY": 2, "ADGRP": 7}, genre_cells=((1, 1, 1),))
    reference = frames.genre_reference
    found = affinity.base_by_upper_name(
        totals(frames), reference, "GENRE_DISPLAY_NAME", frames.genre_channel, SELECTION, affinity.GENRE
    )
    assert [(row.category, row.affinity_denom and float(row.affinity_denom)) for row in found.orderBy("category").collect()] == [
        ("genre 1", 5.0),
        ("genre 2", None),
    ]


def test_display_names():
    names = present.display_names(affinity.GENRE, "ADGRP")
    assert names["prog_metric"] == "Total AD GRP"
    assert names["client_metric"] == "Client AD GRP"
    assert (names["category"], names["level"]) == ("Genre", "Network")
