from reachlens.operators import affinity, insights

RULES = insights.Rules(home="Home")
COLUMNS = (
    "category string, level string, prog_metric double, client_metric double, overall_share double,"
    " affinity double, ntwk string"
)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def data(spark):
    return frame(
        spark,
        ("a", "l", 10.0, 5.0, 10.0, 20.0, "Other"),
        ("b", "l", 10.0, 5.0, 10.0, 30.0, None),
        ("c", "l", 10.0, 6.0, 12.0, 40.0, "Other"),
        ("d", "l", 10.0, 7.0, 14.0, 49.0, "Other"),
        ("e", "l", 10.0, 2.0, 4.0, 120.0, "Home"),
        ("f", "l", 10.0, None, None, 130.0, "Home"),
        ("g", "l", 10.0, 25.0, 50.0, None, "Home"),
        ("h", "l", 30.0, 0.0, 0.0, 100.0, "Home"),
    )


def listed(df):
    return [(row.insight, row.position, row.category) for row in df.orderBy("insight", "position").collect()]


def test_all_rules_in_order(spark):
    found = insights.insights(data(spark), affinity.CHANNEL, "ADGRP", RULES)
    assert listed(found) == [
        (1, 0, None),
        (2, 1, "d"),
        (2, 2, "c"),
        (2, 3, "a"),
        (3, 1, "h"),
        (3, 2, "e"),
        (4, 0, None),
        (5, 1, "d"),
        (5, 2, "c"),
        (5, 3, "a"),
    ]
    texts = {row.insight: row.statement for row in found.collect()}
    assert texts[1] == "Home market share is 60.00% of Total AD GRPs while client spends 54.00% on Home"
    assert texts[2] == "High Spend by client on low ROI competitive Channel: Spend > [5] %, and TG-Affinity < [50]."
    assert texts[4] == "No of Channel on Home with TG-Affinity >= 100 : 2"


def test_a_rule_without_rows_is_left_out(spark):
    found = insights.insights(frame(spark, ("a", "l", 1.0, 1.0, 100.0, 100.0, "Home")), affinity.SHOW, "FCT", RULES)
    assert listed(found) == [(1, 0, None), (4, 0, None)]


def test_genre_level_counts_channels(spark):
    channels = frame(spark, ("x", "l", 1.0, 1.0, 100.0, 100.0, "Home"), ("y", "l", 1.0, 1.0, 1.0, 99.0, "Other"))
    found = insights.insights(data(spark), affinity.GENRE, "ADGRP", RULES, channels)
    texts = {row.insight: row.statement for row in found.collect()}
    assert texts[4] == "No of Channel on Home with TG-Affinity >= 100 : 1"
    assert (5, 1, "y") in listed(found)


def test_no_values_at_all_is_zero_share(spark):
    (row,) = insights.home_share(frame(spark, ("a", "l", 0.0, 0.0, None, None, "Home")), RULES).collect()
    assert (row.market_share, row.client_share) == (0.0, 0.0)
