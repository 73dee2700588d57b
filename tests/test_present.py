import pytest
from helpers import rows
from pyspark.sql import functions as F

from reachlens.functions import text
from reachlens.operators import affinity, params, present
from reachlens.schemas import REF_GENRE_TG_MKT

COLUMNS = (
    "category string, level string, genre string, ntwk string, prog_metric double, genre_share double,"
    " affinity double, client_metric double, client_genre_share double, overall_share double"
)


def frame(spark, *rows):
    """(category, network, total, affinity, client)"""
    full = [(c, "lv", "g", n, p, 1.0, a, m, 2.0, 3.0) for c, n, p, a, m in rows]
    return spark.createDataFrame(full, COLUMNS)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (2.5e12, "2.5lk cr"),
        (12345678.0, "1.2cr"),
        (150000.0, "1.5lk"),
        (1000.0, "1.0k"),
        (999.94, "999.9"),
        (0.25, "0.3"),
        (1.5e15, "1,500.0lk cr"),
    ],
)
def test_units(spark, value, expected):
    assert one(spark, text.unit_text(F.lit(value))) == expected


def test_cells(spark):
    def cell(maker, value):
        found = one(spark, maker(F.lit(value).cast("double")))
        return found.raw, found.text

    assert cell(text.share_cell, 1234.567) == ("1,234.57", "1,235")
    assert cell(text.affinity_cell, 99.5) == ("99.50", "100%")
    assert cell(text.metric_cell, 1234.5) == ("1,235", "1.2k")
    for maker in (text.share_cell, text.affinity_cell, text.metric_cell):
        assert cell(maker, None) == ("0", "NA")
    assert one(spark, F.round(F.lit(2.5), 0)) == 3.0


def test_labels(spark):
    assert one(spark, text.short_label(F.lit("Zee Network"), "Network")) == "Zee"
    assert one(spark, text.short_label(F.lit("abcdefghijk"))) == "abcdefghij.."
    assert one(spark, text.short_label(F.lit("abcdefghij"))) == "abcdefghij"


def test_clean_up(spark):
    assert one(spark, text.ascii_only(F.lit("Café"))) == "Caf"
    assert one(spark, text.ascii_only(F.lit(None).cast("string"))) == ""
    assert one(spark, text.slug(F.lit("A-b c_1!"))) == "Abc_1"
    assert one(spark, text.spell_ampersand(F.lit("R&D"))) == "RandD"


def test_clubbing(spark):
    data = frame(
        spark,
        ("a", "N1", 10.0, 50.0, 9.0),
        ("b", "N2", 10.0, 50.0, 8.0),
        ("c", "N3", 10.0, 50.0, 7.0),
        ("d", "N4", 10.0, 50.0, 6.0),
        ("e", "N5", 10.0, 50.0, 5.0),
        ("e", "N6", 30.0, 70.0, 1.0),
        ("f", "OTHERS", 10.0, 50.0, 99.0),
        ("g", "N1", 10.0, 50.0, None),
        ("h", None, 10.0, 50.0, 1.0),
    )
    assert rows(present.top_networks(data), "ntwk") == [("n1",), ("n2",), ("n3",), ("n4",)]
    assert rows(present.club_others(data), "category", "ntwk", "prog_metric", "client_metric") == [
        ("a", "n1", 10.0, 9.0),
        ("b", "n2", 10.0, 8.0),
        ("c", "n3", 10.0, 7.0),
        ("d", "n4", 10.0, 6.0),
        ("e", "Others", 20.0, 3.0),
        ("f", "Others", 10.0, 99.0),
        ("h", "Others", 10.0, 1.0),
    ]


def test_extents_and_range(spark):
    data = frame(spark, ("a", "n", 10.4, 20.6, 1.0), ("b", "n", 99.2, 80.2, 4.0), ("c", "n", 50.0, None, 2.0))
    (ends,) = present.axis_extents(data).collect()
    assert (ends.x_lo, ends.x_hi, ends.y_lo, ends.y_hi) == (20.0, 81.0, 10.0, 100.0)
    assert round(ends.chart_x_lo, 6) == round(20.6 - 0.08 * 59.6, 6)
    assert round(ends.chart_y_hi, 6) == round(99.2 * 1.09, 6)
    assert (ends.y_mid, ends.bubble_max) == ((10.4 + 99.2) / 2, 4.0)
    assert rows(present.axis_range(data), "category") == [("a",), ("b",)]
    assert rows(present.axis_range(data, x_hi=80.0), "category") == [("a",)]


def test_extents_of_a_single_value_are_widened(spark):
    (ends,) = present.axis_extents(frame(spark, ("a", "n", 10.0, 20.0, 1.0))).collect()
    assert (ends.chart_x_lo, ends.chart_x_hi) == (19.0, 21.0)
    assert round(ends.chart_y_hi, 6) == round(11 * 1.09, 6)


def test_bubbles(spark):
    data = present.club_others(frame(spark, ("a", "Net One", 10.0, 20.0, 4.0), ("b", "others", 5.0, None, 2.0)))
    colors = spark.createDataFrame([("net one", "#111111"), ("others", "#eeeeee")], "Network string, HexCode string")
    found = present.bubbles(data, present.top_networks(data), colors)
    assert rows(found, "category", "x", "y", "radius", "color", "row_slug", "network_slug") == [
        ("a", 20.0, 10.0, 10.0, "#111111", "a-lv", "Net"),
        ("b", 0.0, 5.0, 5.0, "#eeeeee", "b-lv", "Others"),
    ]


def test_search_is_case_insensitive(spark):
    data = frame(spark, ("News", "Alpha", 1.0, 1.0, 1.0), ("Film", "Beta", 1.0, 1.0, 1.0))
    assert rows(present.search(data, "ALPHA|x"), "category") == [("News",)]


def test_base_market_text(spark):
    reference = spark.createDataFrame(
        [
            (1, "G", "g", 1, 1, "CUST_SALES", "old"),
            (1, "G", "g", 11, 1, "CUST_SALES/BARC", "new"),
            (2, "H", "h", 1, 1, "CUST_SALES", "only old"),
        ],
        REF_GENRE_TG_MKT,
    )
    markets = present.base_markets(reference, "GENRE_DISPLAY_NAME")
    shown = markets.select(
        "name", present.base_text(201512).alias("before"), present.base_text(201513).alias("after")
    )
    assert rows(shown, "name", "before", "after") == [("g", "old", "new"), ("h", "only old", "")]


def test_top_rows_put_missing_values_last(spark):
    data = frame(spark, ("a", "n", 5.0, 1.0, None), ("b", "n", 1.0, 1.0, 1.0), ("c", "n", 9.0, 1.0, 2.0))
    assert [row.category for row in present.top_rows(data, 2).collect()] == ["c", "b"]
    assert [row.category for row in present.top_rows_by_total(data, 1).collect()] == ["c"]


def test_export(spark):
    exported = present.export_rows(frame(spark, ("a", "n", 1.005, 1.239, 2.0)), affinity.GENRE, "ADGRP")
    assert exported.columns[:3] == ["Genre", "Network", "Total AD GRP"]
    assert exported.first()["Affinity"] == 1.24
    chosen = present.export_selection(spark, {"Client": "x", "Metric": "ADGRP"})
    assert [(row.position, row.name, row.value) for row in chosen.collect()] == [
        (0, "Client", "x"),
        (1, "Metric", "ADGRP"),
    ]


def test_names_to_keys_and_validation(spark):
    domain = spark.createDataFrame([(7, "x"), (3, "x"), (5, "y")], "key int, name string")
    chosen = spark.createDataFrame([("x",), ("z",)], "name string")
    assert rows(params.to_keys(chosen, domain), "name", "key") == [("x", 3), ("z", -1)]
    pairs = spark.createDataFrame([("client", "x")], "parameter string, name string")
    params.require_known(pairs, pairs)
    with pytest.raises(params.InvalidParameter, match="unknown client: x"):
        params.require_known(pairs, pairs.limit(0))
